"""Notices that a text holds many times."""

import pytest

from quillon.llm import licenses


@pytest.mark.parametrize("notice,name", [("Released under the MIT License", "MIT"), ("All rights reserved", "proprietary"), ("Licensed under CC BY-SA 4.0", "CC-BY-SA-4.0")])
@pytest.mark.parametrize("between", [0, 1, 4, 9, 30])
def test_every_notice_of_a_list_is_found(notice, name, between):
    text = "\n".join(" ".join(["foo"] * between + [notice]) for _ in range(100))
    words = len(licenses._words(notice))
    want = [(name, k * (words + between) + between, (k + 1) * (words + between) - 1, words, words) for k in range(100)]
    assert licenses.Index().matches([text]) == [want]


def test_long_notices_one_after_the_other():
    notice = licenses.TEMPLATES["GPL-2.0-notice"]
    found = licenses.Index().matches([f"{notice} {notice} foo {notice}"])[0]
    assert [m[0] for m in found] == ["GPL-2.0-notice"] * 3 and all(m[3] == m[4] for m in found)
