"""Token ids of texts that the given documents do not hold, against ``tokenizers``."""

import pytest
from tokenizers import Tokenizer

from quillon.llm import packing


@pytest.mark.parametrize("text", ["a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|>\n<|endoftext|> y", "<|endoftext", " " * 1_200_000 + "word", "a" + "\n" * 1_200_000 + "b", "\t " * 600_000 + "x", " " * 99_999 + "x", "!" * 1_200_000])
def test_ids_are_those_of_tokenizers(text):
    path = packing.public_vocabulary()
    assert packing.encoder(path).encode_ordinary(text) == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_pieces_of_an_added_token(spark):
    got = packing.pieces(spark.createDataFrame([(1, "a<|endoftext|>b")], "doc_id long, text string")).first()
    assert (got.length, bytes(got.ids)) == (4, b"".join(k.to_bytes(4, "little") for k in (64, 50256, 65, 2)))


def test_the_program_packs_tighter_than_best_fit_alone(monkeypatch):
    """Pieces of just over and under halves and quarters, of which best fit wastes a fifth, and lengths at random."""
    import random
    from collections import Counter

    from quillon.llm import packing

    rng = random.Random(1)
    hard = {514: 600, 260: 600, 258: 600, 252: 1200}
    spread = dict(Counter(rng.randrange(250, 520) for _ in range(20_000)))
    found = {}
    for parts in ((0.0,), packing.PARTS):
        monkeypatch.setattr(packing, "PARTS", parts)
        found[parts] = [packing.solve(h).sequences for h in (hard, spread)]
    alone, program = found.values()
    assert (alone[0], program[0]) == (1100, 900)  # 900 is the least there can be
    assert program[1] <= 0.97 * alone[1]
