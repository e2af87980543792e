"""Operators that compare documents, packing, and the pipeline, against brute force."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.llm import lines, packing, passages, simhash
from quillon.llm.queries import QUERIES
from quillon.llm.suffix import permuted_lcp, suffix_array


def rows_of(docs):
    return sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())


def brute_fingerprint(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + width]), seed=42) for k in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_query(spark, sf_dir, docs):
    rows = rows_of(docs)
    prints = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    want = {(d, f"{f:016x}", rows[r][0]) for (d, _), f, r in zip(rows, prints, root, strict=True)}
    assert {tuple(r) for r in QUERIES["op2_simhash"](spark, sf_dir).collect()} == want


@pytest.mark.parametrize("budget", [1, 3, 4, 6])
def test_trie_links_against_all_pairs(spark, budget):
    rng = np.random.default_rng(budget)
    values = set()
    for base in rng.integers(0, 1 << 63, 25, dtype=np.uint64).tolist():
        for _ in range(40):
            for k in rng.integers(0, 64, rng.integers(0, 4)).tolist():
                base ^= 1 << k
            values.add(base)
    v = np.array(sorted(values), dtype=np.uint64)
    near = np.bitwise_count(v[:, None] ^ v[None, :]) <= budget
    want = simhash.Forest(len(v))
    want.link(*np.nonzero(near))
    edges = simhash.trie_links(v, np.zeros(len(v), dtype=np.int64), budget, frontier=50)
    got = simhash.Forest(len(v))
    got.link(edges[:, 0], edges[:, 1])
    assert (got.roots() == want.roots()).all()
    # the distributed form finds the same components
    signed = v.view(np.int64)
    frame = spark.createDataFrame([(int(x),) for x in signed], "fingerprint long")
    pairs = simhash.links(frame, budget).collect()
    at = {int(x): k for k, x in enumerate(signed)}
    spread = simhash.Forest(len(v))
    spread.link(np.array([at[p.src] for p in pairs], dtype=np.int64), np.array([at[p.dst] for p in pairs], dtype=np.int64))
    assert (spread.roots() == want.roots()).all()


def test_parts_hold_enough_bits():
    assert simhash.parts_for(10, 4) == 5
    assert simhash.parts_for(10**10, 4) > 5
    for parts in (5, 6, 8):
        masks = simhash.masks(parts, 4)
        rng = random.Random(parts)
        for _ in range(200):
            differ = sum({1 << rng.randrange(64) for _ in range(4)})
            assert any(differ & m == 0 for m in masks)


def test_simhash_of_odd_rows(odd, none):
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()]
    assert sorted(ids) == [1, 1, 3, 6, 7]  # rows that share an id stay together; texts without words are one group
    assert simhash.one_of_each(none).count() == 0


def brute_lines(rows, least=1):
    seen, out = [], {}
    for d, t in rows:
        gone = []
        for k, line in enumerate((t or "").split("\n")):
            tokens = {w for w in line.lower().split(" ") if w}
            if len(tokens) < least:
                continue
            if any(5 * len(tokens & s) >= 4 * len(tokens | s) for s in seen if 4 * len(s) <= 5 * len(tokens) and 4 * len(tokens) <= 5 * len(s)):
                gone.append(k)
            seen.append(tokens)
        out[d] = gone
    return out


def test_line_dedup(docs):
    rows = rows_of(docs)[:120]
    some = docs.where(f"doc_id <= {rows[-1][0]}")
    assert {r.doc_id: r.removed for r in lines.deduplicated(some).collect()} == brute_lines(rows)


def test_line_dedup_of_a_template_with_slots(spark):
    """Many near copies of one line, and lines that the earliest of a token does not settle."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    base = words[:20]
    texts = []
    for _ in range(150):
        line = list(base)
        for _ in range(rng.randrange(4)):
            line[rng.randrange(20)] = rng.choice(words)
        texts.append(" ".join(line))
    rows = list(enumerate(texts))
    got = {r.doc_id: r.removed for r in lines.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == brute_lines(rows)


def test_line_dedup_of_odd_rows(odd, none):
    out = lines.clean_documents(odd)
    assert out.columns == odd.columns
    kept = sorted((r.doc_id, r.text) for r in out.where("doc_id IS NOT NULL AND doc_id < 6").select("doc_id", "text").collect() if r.text is not None)
    assert [d for d, _ in kept] == [1, 1, 4, 5]
    assert out.where("doc_id = 3 OR doc_id IS NULL").count() == 2
    assert out.where("doc_id = 7").first().text.split("\n")[0] == "the same line of words again"
    assert lines.deduplicated(none, removed="r").count() == 0


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=80), st.integers(1, 4))
def test_suffix_array_and_common_prefixes(data, symbols):
    text = np.frombuffer(bytes(b % symbols for b in data), dtype=np.uint8)
    raw = text.tobytes()
    order = suffix_array(text).tolist()
    assert order == sorted(range(len(raw)), key=lambda k: raw[k:])
    if len(raw) > 1:
        lcp = permuted_lcp(text, np.array(order), 20)
        for a, b in zip(order, order[1:], strict=False):
            same = 0
            while same < 20 and max(a, b) + same < len(raw) and raw[a + same] == raw[b + same]:
                same += 1
            assert lcp[b] == same


def brute_passages(rows, length=50):
    first: dict = {}
    out = {}
    texts = [(d, (t or "").encode()) for d, t in rows if d is not None]
    for d, t in texts:
        for k in range(len(t) - length + 1):
            first.setdefault(t[k : k + length], d)
    for d, t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] < d:
                gone[k : k + length] = b"\1" * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[d] = (len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest())
    return out


def test_suffix_dedup_query(spark, sf_dir, docs):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in QUERIES["op9_suffix_dedup"](spark, sf_dir).collect()}
    assert got == brute_passages(rows_of(docs))


@pytest.mark.parametrize("hot", [1, 2048])
def test_suffix_dedup_of_overlaps_and_runs(spark, hot):
    rng = random.Random(9)
    pool = ["".join(rng.choice("abé ") for _ in range(90)) for _ in range(6)]
    rows = [(k, "".join(rng.choice(pool)[rng.randrange(40) : rng.randrange(50, 90)] for _ in range(rng.randrange(6)))) for k in range(60)]
    rows += [(100, "a" * 500), (101, "a" * 60 + "b"), (102, "x" * 49), (103, "x" * 49), (104, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    spans = {r.doc_id: r.spans for r in passages.with_spans(frame, hot=hot).collect()}
    want = brute_passages(rows)
    for d, t in rows:
        data, gone = (t or "").encode(), passages._union(spans[d])
        kept = passages._kept(data, gone)
        assert (len(data), sum(b - a for a, b in gone), len(gone), hashlib.sha256(kept).hexdigest()) == want[d]


def test_suffix_dedup_of_odd_rows(odd, none):
    got = passages.kept_bytes(odd, name="k")
    assert got.where("doc_id = 1 AND length(k) = length(text)").count() == 2  # rows of one id remove nothing from each other
    assert got.where("doc_id IN (2, 8) AND length(k) = 0").count() in (0, 2)
    assert got.where("doc_id IS NULL AND k = cast(text AS binary)").count() == 1
    assert passages.kept_bytes(none, name="k").count() == 0


def check_packing(rows, ids, capacity=1024):
    by_doc, held = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    for d, of in ids.items():
        at = 0
        for k, r in enumerate(sorted(by_doc[d], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and 0 < r.length <= capacity and (k == 0 or r.length == capacity)
            assert r.ids_crc32 == zlib.crc32(np.array(of[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(of)
    return len(held)


def test_packing_query_by_the_other_tokenizer(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.public_vocabulary())
    rows = rows_of(docs)
    ids = {d: [*e.ids, 2] for (d, _), e in zip(rows, tokenizer.encode_batch([t or "" for _, t in rows], add_special_tokens=False), strict=True)}
    n = check_packing(QUERIES["op8_best_fit_packing"](spark, sf_dir).collect(), ids)
    lengths = [k for of in ids.values() for k in ((len(of) - 1) % 1024 + 1, *[1024] * ((len(of) - 1) // 1024))]
    assert n <= best_fit_decreasing(lengths, 1024)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 400), min_size=1, max_size=12))
def test_solver_packs_all_and_near_the_bound(histogram):
    plan = packing.solve(histogram, capacity=30, rounds=60)
    packed = collections.Counter()
    for n, lengths in plan.kinds:
        assert n > 0 and sum(lengths) <= 30
        for length in lengths:
            packed[length] += n
    assert packed == histogram
    assert plan.lower_bound - 1e-6 <= plan.sequences
    bins = best_fit_decreasing([k for k, n in histogram.items() for _ in range(n)], 30)
    assert plan.sequences <= bins * 1.03 + 2


def best_fit_decreasing(lengths, capacity):
    bins = []
    for k in sorted(lengths, reverse=True):
        fit = min((r for r in bins if r >= k), default=None)
        if fit is not None:
            bins.remove(fit)
        bins.append((capacity if fit is None else fit) - k)
    return len(bins)


def test_packing_of_odd_rows_and_the_sequences(spark, odd, none):
    given_ = odd.where("doc_id <> 1")
    found = packing.packed(given_, capacity=64)
    assert found.where("doc_id IN (3, 4)").selectExpr("length", "hex(ids) AS ids").distinct().collect() == [(1, "02000000")]
    total = found.selectExpr("sum(length) AS n").first().n
    whole = packing.sequences(found).selectExpr("length(ids) AS n").collect()
    assert sum(r.n for r in whole) == 4 * total and max(r.n for r in whole) <= 4 * 64
    twice = packing.packed(odd.where("doc_id = 1"), with_ids=False).collect()
    assert len(twice) == 2 and len({(r.sequence_id, r.offset) for r in twice}) == 2
    assert packing.packed(none).count() == 0



def test_pipeline_against_brute_force(spark, sf_dir, docs):
    import corpus_pipeline
    from oracle import sql_rows

    from quillon.llm.queries import ORACLES

    sizes, kept = [], docs
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = rows_of(kept)
        kept = stage(spark, kept, sf_dir).cache()
        assert kept.columns == docs.columns
        after = rows_of(kept)
        sizes.append(len(after))
        if name == "quality rules":
            names, good = sql_rows(ORACLES["op7_quality_rules"], sf_dir)
            ids = {r[names.index("doc_id")] for r in good if r[names.index("kept")]}
            assert after == [r for r in before if r[0] in ids]
        if name == "line dedup":
            gone = brute_lines(before)
            want = [(d, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in set(gone[d]))) for d, t in before]
            assert after == [(d, t) for d, t in want if not gone[d] or t.strip(" ")]
        if name == "SimHash near-dedup":
            prints = {d: brute_fingerprint(t) for d, t in before}
            assert len(after) < len(before) or len(set(prints.values())) == len(prints)
            assert {prints[d] for d, _ in after} <= set(prints.values())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    from quillon.llm import decontam

    assert decontam.hits(kept, benchmark).where("size(hits.spans) > 0").count() == 0
    tokens = packing.encoder(packing.public_vocabulary())
    check_packing(corpus_pipeline.run(spark, sf_dir).collect(), {d: [*tokens.encode_ordinary(t), 2] for d, t in rows_of(kept)})
