"""Operators of training data against brute force, and their defined results in odd cases."""

from __future__ import annotations

import hashlib
import math
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from tallywright.llm import (  # noqa: E402
    bag_minhash,
    decontamination,
    lattice,
    main_text,
    packing,
    quality,
    queries,
    repeats,
    token_counts,
    topk,
    training_order,
)
from tallywright.llm.components import components  # noqa: E402
from tallywright.llm.tokens import library, stretch_ids  # noqa: E402

DATA = "/root/testdata/sf0.001"
WORDS, BYTES = queries.vocabulary("word_bpe_49k.json"), queries.vocabulary("byte_bpe_50k.json")
PIECES = queries.vocabulary("piece_bpe_32k.model")

#: Columns of documents and one whose names clash with what operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, rest string, label int"
LONG = " ".join(f"word{i * i % 977} ab{i}" for i in range(6000))
PASSAGE = "the passage that many documents share is long enough to be found by every operator that looks for it "
ODD = [
    (5, None),
    (3, ""),
    (4, "   \n\t "),
    (None, "a row without an id " * 4),
    (1, "one two three four five six seven eight nine ten eleven"),
    (1, "one two three four five six seven eight nine ten eleven"),
    (2, PASSAGE * 3),
    (9, PASSAGE * 3),
    (8, "x" + PASSAGE * 2 + "y"),
    (7, LONG),
    (6, "é" * 40 + " <|endoftext|> Straße 'll 12 don't ½   漢字 " + PASSAGE),
    (0, "short"),
]


def documents(spark, rows):
    full = [(i, t, "en", "s", None if t is None else len(t), 1, "rest", 2) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    documents(spark, ODD).repartition(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def nothing(spark):
    return documents(spark, [])


@pytest.fixture(scope="module")
def given_rows():
    return duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet' ORDER BY doc_id").fetchall()


def rows(df):
    return [tuple(r) for r in df.collect()]


# ------------------------------------------------------------------ tokens, op1, op4, op9

texts = st.lists(
    st.sampled_from(["a", "The", "don't", "I'LL", "'s", "ß", "É", "Σ", "12", "½", "漢", "́", "<|endoftext|>",
                     "<|startoftext|>", " ", "  ", "\n", "\t", " ", " ", "\x1c", "!?", "🙂", "₏", "_", "²"])
).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(texts, max_size=4))
def test_ids_and_counts_are_the_library_s(found):
    words, pieces = library(WORDS), library(BYTES)
    want = [np.array(words.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in found]
    assert stretch_ids(WORDS).ids(found) == want
    want = [len(pieces.encode(t, add_special_tokens=False).ids) for t in found]
    assert token_counts.piece_counts(BYTES).counts(found).tolist() == want


def test_ids_are_the_same_when_the_cache_is_full(monkeypatch, given_rows):
    from tallywright.llm import tokens

    found = [t or "" for _, t in given_rows[:40]]
    want = stretch_ids(WORDS).ids(found)
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 50)
    small = tokens.StretchIds(WORDS)
    assert small.ids(found[:20]) + small.ids(found[20:]) == want


def test_stretches_beyond_the_cache_are_looked_up_once(monkeypatch):
    from tallywright.llm import tokens

    looked_up, plain = [], tokens._PLAIN
    monkeypatch.setattr(tokens, "_PLAIN", lambda s: looked_up.append(s) or plain(s))
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 1)
    small, text = tokens.StretchIds(WORDS), "don't, don't, 12 é"
    want = [np.array(library(WORDS).encode(text, add_special_tokens=False).ids, "<u4").tobytes()]
    assert small.ids([text]) == small.ids([text]) == want
    assert looked_up.count("12") == 1


def test_token_counts(spark, odd, nothing):
    got = {(r[0], r[1], r[2], r[3]) for r in rows(token_counts.count_tokens(odd, BYTES))}
    want = set()
    for i, t in ODD:
        n = len(library(BYTES).encode(t or "", add_special_tokens=False).ids)
        want.add((i, len((t or "").encode()), n, n > 1024))
    assert got == want
    assert rows(token_counts.count_tokens(nothing, BYTES)) == []


def check_pieces(found, source):
    """Every token of every row lies in one piece, and every sequence is full or a power of two."""
    by_sequence = defaultdict(list)
    by_document = defaultdict(list)
    for p in found:
        by_sequence[p.sequence_id].append(p)
        by_document[p.doc_id].append(p)
        assert len(p.ids) == 4 * p.length and p.length > 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048 and at & (at - 1) == 0 and {p.window for p in pieces} == {at}
    want = defaultdict(list)
    for i, t in source:
        ids = library(WORDS).encode(t or "", add_special_tokens=False).ids + [1]
        want[i].append(np.array(ids, "<u4").tobytes())
    for i, texts_of in want.items():
        assert sum(p.length for p in by_document[i]) * 4 == sum(map(len, texts_of))
        if len(texts_of) == 1:
            joined = b"".join(bytes(p.ids) for p in sorted(by_document[i], key=lambda p: p.start))
            assert joined == texts_of[0]
            assert all(p.doc_tokens * 4 == len(joined) for p in by_document[i])
    return by_sequence


def test_packing(spark, odd, nothing, given_rows):
    check_pieces(packing.pack(odd, WORDS).collect(), ODD)
    assert packing.pack(nothing, WORDS).collect() == []
    by_sequence = check_pieces(
        packing.pack(spark.read.parquet(f"{DATA}/documents.parquet"), WORDS).collect(), given_rows
    )
    assert len({p[0].window for p in by_sequence.values()}) >= 3
    steps = defaultdict(set)
    for pieces in by_sequence.values():
        steps[pieces[0].step_group].add(pieces[0].window)
    assert all(len(w) == 1 for w in steps.values())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 9000), max_size=60))
def test_packed_lengths(lengths):
    windows, rest = packing.pack_lengths(lengths)
    tail = packing.power_windows(rest)
    covered = defaultdict(list)
    for size, window in windows + tail:
        assert sum(p[2] for p in window) == size and size & (size - 1) == 0 and size <= 2048
        for document, start, length in window:
            covered[document].append((start, length))
    assert sum(p[2] for p in rest) < 2048
    for document, length in enumerate(lengths):
        at = 0
        for start, part in sorted(covered[document]):
            assert start == at
            at += part
        assert at == length


def test_steps_are_balanced():
    windows = [(256, [(0, 0, n), (1, 0, 256 - n)]) for n in range(1, 255)]
    groups, _ = packing.balanced_steps(windows, 0)
    cost = Counter()
    for g, (_, w) in zip(groups, windows):
        cost[g] += sum(p[2] ** 2 for p in w)
    assert max(cost.values()) < 1.05 * min(cost.values()) or len(cost) == 1


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**64 - 1))
def test_feistel_is_a_permutation(size, key):
    slots = training_order.Feistel(size, key)(np.arange(size))
    assert sorted(slots.tolist()) == list(range(size))


def test_training_order(spark, nothing, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").repartition(3)
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    folder = str(tmp_path / "shards")
    found = training_order.materialise(docs, WORDS, key=3, length=256, folder=folder).collect()
    slots = sorted(r.slot for r in found)
    assert slots == list(range(len(found)))
    files = {p.name: p.read_bytes() for p in Path(folder).glob("*.bin")}
    assert not [p for p in Path(folder).iterdir() if not p.name.endswith(".bin")]
    for r in found:
        record = files[training_order.shard_name(r.shard)][r.byte_offset : r.byte_offset + 512]
        assert len(record) == 512 and zlib.crc32(record) == r.crc32
        assert not any(record[2 * r.n_tokens :])
    # All tokens of all documents, whatever their order.
    want = Counter()
    for i, t in docs.select("doc_id", "text").collect():
        want.update(library(WORDS).encode(t or "", add_special_tokens=False).ids + [1])
    got = Counter()
    for r in found:
        record = files[training_order.shard_name(r.shard)][r.byte_offset : r.byte_offset + 2 * r.n_tokens]
        got.update(np.frombuffer(record, "<u2").tolist())
    assert got == want
    assert {i for r in found for i in r.doc_ids} == {r.doc_id for r in docs.select("doc_id").collect()}
    again = training_order.read_shards(spark, folder, 256)
    assert again.count() == len(found)
    other = training_order.materialise(docs, WORDS, key=4, length=256, folder=str(tmp_path / "o")).collect()
    assert {(r.slot, r.crc32) for r in other} != {(r.slot, r.crc32) for r in found}
    assert training_order.materialise(nothing, WORDS).collect() == []


def test_training_order_of_odd_rows(odd, tmp_path):
    found = training_order.materialise(odd, WORDS, length=64, folder=str(tmp_path / "s")).collect()
    assert {i for r in found for i in r.doc_ids} == {i for i, _ in ODD}


# ------------------------------------------------------------------ op2


def all_segmentations(model, scores, word):
    if not word:
        return 1.0
    total = 0.0
    for n, piece in enumerate(model.pieces[1:], 1):
        if word.startswith(piece):
            total += math.exp(scores[n]) * all_segmentations(model, scores, word[len(piece) :])
    return total


def test_lattice_sums_all_segmentations():
    model = lattice.lattice(PIECES)
    scores = model.first_scores()
    words = [b"the", b"abab", b"x", "é".encode(), b"the"]
    got = model.marginals(words, scores)
    want = [math.log(all_segmentations(model, scores, b" " + w)) for w in words]
    assert np.allclose(got, want)
    assert model.marginals([], scores).tolist() == []
    uses = model.expected([b"the", b"xyz"], scores)
    lengths = np.array([len(p) for p in model.pieces])
    assert math.isclose((uses * lengths).sum(), 8.0, rel_tol=1e-9)
    assert math.isclose(np.exp(scores).sum(), 1.0)


def test_likelihood(spark, odd, nothing, given_rows):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for frame, source in ((docs, given_rows), (odd, ODD)):
        got = lattice.score(frame, PIECES).collect()
        counts, train = Counter(), 0
        for i, t in source:
            if i is not None and zlib.crc32(str(i).encode()) % 10:
                words = lattice.words_of((t or "").encode())
                counts.update([*words, b""])
        train = sum(counts.values())
        want = Counter()
        for i, t in source:
            tokens = [*lattice.words_of((t or "").encode()), b""]
            base = sum(math.log10((counts[w] + 0.1) / (train + 0.1 * (len(counts) + 1))) for w in tokens)
            held = not (i is not None and zlib.crc32(str(i).encode()) % 10)
            want[i, held, len(tokens), sum(counts[w] > 0 for w in tokens), round(base, 5)] += 1
        assert want == Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 5)) for r in got)
        assert {r.train_tokens for r in got} == {train}
        assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    held = [r for r in lattice.score(docs, PIECES).collect() if r.held_out]
    # The baseline has one probability for all unknown words, which no distribution can have.
    assert 1.3 * sum(r.base_score for r in held) < sum(r.score for r in held) < 0
    known = [r for r in lattice.score(docs, PIECES).collect() if not r.held_out]
    assert sum(r.score for r in known) > 1.1 * sum(r.base_score for r in known)
    assert lattice.score(nothing, PIECES).collect() == []


def test_hot_words_and_joined_words_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    full = {r.doc_id: r for r in lattice.score(docs, PIECES).collect()}
    monkeypatch.setattr(lattice, "HOT_WORDS", 5)
    for r in lattice.score(docs, PIECES).collect():
        assert math.isclose(r.score, full[r.doc_id].score, rel_tol=1e-9)
        assert math.isclose(r.base_score, full[r.doc_id].base_score, rel_tol=1e-9)
        assert r.n_known == full[r.doc_id].n_known


# ------------------------------------------------------------------ op3


def without_repeats(source):
    """Brute force over all windows."""
    starts = defaultdict(set)
    for i, t in source:
        b = (t or "").encode()
        if i is not None:
            for k in range(len(b) - 49):
                starts[b[k : k + 50]].add(i)
    low = {w: min(i) for w, i in starts.items()}
    out = []
    for i, t in source:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if i is not None and low[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        spans = sum(bool(g) and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.fixture(scope="module")
def repeated():
    random = np.random.default_rng(5)
    base = ["".join(random.choice(list("abc "), 130)) for _ in range(6)]
    out = []
    for i in range(60):
        parts = [base[k][a : a + random.integers(20, 130)] for k, a in random.integers(0, 6, (4, 2)) * [1, 9]]
        out.append((int(random.integers(0, 40)), "".join(parts) + "ab" * int(random.integers(0, 90))))
    return out


@pytest.mark.parametrize("hot", [10_000, 2])
def test_repeats(spark, odd, nothing, repeated, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_DOCUMENTS", hot)
    monkeypatch.setattr(repeats, "HOT_KEYS", 10**9)
    documents(spark, repeated).repartition(4).write.parquet(str(tmp_path / "d"))
    frame = spark.read.parquet(str(tmp_path / "d"))
    for docs, source in ((frame, repeated), (odd, ODD)):
        assert Counter(rows(repeats.digest(repeats.without_repeats(docs)))) == without_repeats(source)
    assert rows(repeats.without_repeats(nothing)) == []


def test_small_batches_give_the_same(spark, repeated, tmp_path, monkeypatch):
    monkeypatch.setattr(repeats, "HELD_RUNS", 50)
    monkeypatch.setattr(repeats, "HELD_BYTES", 2000)
    documents(spark, repeated).repartition(3).write.parquet(str(tmp_path / "d"))
    got = repeats.digest(repeats.without_repeats(spark.read.parquet(str(tmp_path / "d"))))
    assert Counter(rows(got)) == without_repeats(repeated)


class InOneTask:
    """As much of a DataFrame as the steps of op3 need, over record batches."""

    def __init__(self, batches):
        self.batches = batches

    def mapInArrow(self, work, schema):
        return InOneTask(list(work(iter(self.batches))))

    def repartition(self, *by):
        return self  # there is one bucket

    def sortWithinPartitions(self, *by):
        return self


def test_only_strings_that_may_share_windows_are_put_in_order(monkeypatch):
    """Copies are settled as whole strings and lead to few ranges; edges of passages need the order."""
    random = np.random.default_rng(8)
    texts = ["".join(random.choice(list("abcdefgh "), 3000)) for _ in range(12)]
    source = [(i, t) for i, t in enumerate(texts * 2)] + [(99, "y" * 30 + texts[3][700:900] + "z" * 30)]
    ids = pa.array([i for i, _ in source], pa.int64())
    raw = pa.array([t.encode() for _, t in source], pa.binary())
    own = InOneTask([pa.RecordBatch.from_arrays([ids, ids, raw], names=["row", "doc_id", "text"])])
    shared = repeats.shared_runs(repeats.keys_sent(own, 1), 1, 10**6).batches
    runs = defaultdict(set)
    for r in pa.Table.from_batches(shared).to_pylist():
        runs[r["row"]].add(r["run"])
    (packed,) = repeats.packed_texts(own).batches
    wanted = pa.array([sorted(runs[i]) for i, _ in source], pa.list_(pa.int32()))
    with_runs = InOneTask([packed.append_column("runs", wanted)])
    order, windows = repeats.suffix_order, []
    monkeypatch.setattr(repeats, "suffix_order", lambda t, s: windows.append(len(s)) or order(t, s))
    ranges = repeats.covered_ranges(repeats.strings_sent(with_runs, 1, set()), 1).batches
    found = defaultdict(list)
    for r in pa.Table.from_batches(ranges).to_pylist():
        found[r["row"]].append((r["first"], r["last"]))
    assert dict(found) == {i: [(0, 3000)] for i in range(12, 24)} | {99: [(30, 230)]}
    assert 0 < sum(windows) < 500  # of 12 * 2951


def test_previous_factors_by_definition():
    random = np.random.default_rng(1)
    text = np.frombuffer(bytes(random.choice([97, 98], 400)) + bytes(60), np.uint8)
    text = np.r_[text, text, text]
    starts = random.permutation(len(text) - 60)[:300]
    docs = random.integers(0, 9, 300)
    order, common = repeats.suffix_order(text, starts)
    cut = [bytes(text[s : s + 50]) for s in starts]
    assert [cut[i] for i in order] == sorted(cut)
    got = np.zeros(300, bool)
    got[order] = repeats.previous_factors(docs[order], common)
    want = [any(cut[j] == cut[i] and docs[j] < docs[i] for j in range(300)) for i in range(300)]
    assert got.tolist() == want


# ------------------------------------------------------------------ op5


@pytest.mark.parametrize("scale", [1.0, 1e12])
def test_top_k(spark, scale):
    random = np.random.default_rng(2)
    vectors = [(int(i), [float(np.float32(x * scale)) for x in random.normal(0, 1, 6)]) for i in range(300)]
    vectors += [(i, vectors[7][1]) for i in range(300, 380)]  # ties
    vectors += [(50, vectors[3][1]), (None, vectors[1][1]), (400, None), (401, []), (402, [1.0, None] * 3),
                (403, [float("nan")] * 6), (404, [float("inf")] * 6), (405, [1.0, 2.0]), (450, [3.0, 1.0])]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(4)
    ints = topk.integer_vectors(frame)
    got = Counter(rows(topk.top_k(ints, ints.where("vec_id % 50 = 0"), 5)))
    usable = [
        (i, [math.floor(256 * x) for x in v]) for i, v in vectors
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    want = Counter()
    for q, v in {(q, tuple(v)) for q, v in usable if q % 50 == 0}:
        scored = sorted(
            (-sum(a * b for a, b in zip(v, w)), i) for i, w in usable if i != q and len(w) == len(v)
        )[:5]
        want.update((q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1))
    if scale == 1.0:
        assert got == want
    else:
        assert sum(got.values()) == sum(want.values())  # scores beyond 64 bits are clipped


def test_top_k_in_small_blocks_with_many_rows_of_one_id(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    random = np.random.default_rng(5)
    vectors = [(int(i), [float(x) for x in random.normal(0, 1, 4)]) for i in range(120)]
    vectors += [(50, [float(x) for x in random.normal(0, 1, 4)]) for _ in range(7)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    ints = topk.integer_vectors(frame)
    got = Counter(rows(topk.top_k(ints, ints.where("vec_id % 50 = 0"), 3)))
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors]
    want = Counter()
    for q, v in {(q, tuple(v)) for q, v in usable if q % 50 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in usable if i != q)[:3]
        want.update((q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1))
    assert got == want and sum(got.values()) == 3 * (3 + 7)


def test_top_k_of_nothing(spark):
    frame = spark.createDataFrame([], "vec_id long, embedding array<float>")
    ints = topk.integer_vectors(frame)
    assert rows(topk.top_k(ints, ints, 5)) == []


# ------------------------------------------------------------------ op6

PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><a href=/>Home</a></header><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav>
<div class="cookie-notice">We use cookies</div><main><article><h1>Title</h1>
<p><b>First block of the article, with &amp; and &eacute;.<br>More<p>Second block, which is also
long   enough to count as text of the page.</p></article>
<div id="comments"><p>A comment that is long, so long that it could be an article of its own, or nearly.</p></div>
</main><aside><p>Aside</p></aside><form><input><label>Name</label></form><footer>&copy; x</footer></body></html>"""


def test_main_text(spark):
    want = (
        "Title\n\nFirst block of the article, with & and é. More\n\n"
        "Second block, which is also long enough to count as text of the page."
    )
    assert main_text.main_text(PAGE) == want
    pages = [(1, "u", PAGE), (1, "u", PAGE), (None, None, ""), (2, "v", None), (3, "w", "plain"),
             (4, "x", "<p>" * 3000 + "deep"), (5, "y", "<a href=x>only a link</a>"), (6, "z", "<div>a<"),
             (7, "t", "<script>never closed")]
    frame = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, text int")
    got = Counter(rows(main_text.extract(frame)))
    assert got[1, "u", want, len(want)] == 2 and got[None, None, "", 0] == 1 and got[2, "v", "", 0] == 1
    assert got[3, "w", "plain", 5] == got[4, "x", "deep", 4] == got[5, "y", "only a link", 11] == 1
    assert got[7, "t", "", 0] == 1 and len(got) == 8
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert rows(main_text.extract(empty)) == []


@pytest.mark.parametrize("wrapper", ['div class="content has-sidebar"', 'div id="page" class="no-comments"',
                                     'div class="entry ad-free"', "form id=aspnetForm", 'div class="search"'])
def test_main_text_in_a_wrapper_with_a_name(wrapper):
    blocks = [f"Block {i} of the text, which is long enough to count as text of the page." for i in range(4)]
    inner = "".join(f"<p>{b}</p>" for b in blocks[:3]) + f'<div class="legal-advice"><p>{blocks[3]}</p></div>'
    page = f'<body><div class=sidebar><p>Beside it</p></div><{wrapper}>{inner}</{wrapper.split()[0]}></body>'
    assert main_text.main_text(page) == "\n\n".join(blocks)


def test_main_text_of_the_given_pages():
    import html
    import re

    for _, source in duckdb.sql(f"SELECT page_id, html FROM '{DATA}/pages.parquet'").fetchall():
        inner = re.search(r"<article>(.*?)</article>", source, re.S).group(1)
        blocks = re.sub(r"<[^>]*>", " ", re.sub(r"</?(?:p|h1)\b[^>]*>", "\0", inner)).split("\0")
        want = [" ".join(html.unescape(b).split()) for b in blocks]
        assert main_text.main_text(source) == "\n\n".join(b for b in want if b)


# ------------------------------------------------------------------ op7


def test_gradients_are_right():
    model = quality.Attention.new(1)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    random = np.random.default_rng(0)
    x, owner, y = random.normal(0, 1, (7, quality.FEATURES)), np.array([0, 0, 1, 1, 1, 2, 2]), np.array([1.0, 0, 1])

    def loss():
        p = model.forward(x, owner, 3)["p"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    found = model.gradients(x, owner, y, model.forward(x, owner, 3))
    for name in ("encode", "tanh", "gate", "weigh", "score", "score_0"):
        flat = model.weights[name].reshape(-1)
        for k in random.integers(0, len(flat), 3):
            old = flat[k]
            flat[k] = old + 1e-5
            up = loss()
            flat[k] = old - 1e-5
            down = loss()
            flat[k] = old
            assert math.isclose((up - down) / 2e-5, found[name].reshape(-1)[k], abs_tol=2e-5)


def test_quality(spark, odd, nothing):
    data = DATA.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    got = quality.classify(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    truth = dict(labels.select("doc_id", "quality").collect())
    judged = [r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]
    assert sum(judged) / len(judged) > 0.93
    # Without labels, with useless ones, and without documents.
    none = spark.createDataFrame([(None, 1), (1, None), (2, 7)], "doc_id long, quality int")
    assert {r.score for r in quality.classify(odd, none).collect()} == {0.5}
    assert len(quality.classify(odd, labels).collect()) == len(ODD)
    assert rows(quality.classify(nothing, labels)) == []
    assert rows(quality.keep_good(nothing, labels, 0.4)) == []


def test_quality_learns_from_every_passage_of_whole_rows(spark):
    long = b"a sentence of a long text. " * 400
    assert len(quality.bag(long)) == -(-len(long) // quality.PASSAGE) and len(quality.bag(b"")) == 1
    assert quality.within([5, 5, 5], 10) == 2 and quality.within([50, 1], 10) == 1
    assert quality.within([], 10) == 0 and quality.within([3, 3], 100) == 2
    from pyspark.sql import functions as F

    n = spark.createDataFrame([(None,), ("",), ("x" * 601,)], "t string").select(quality.passages_of(F.col("t")))
    assert [r[0] for r in n.collect()] == [1, 1, 2]


# ------------------------------------------------------------------ op8


def test_containment(spark, odd, nothing):
    items = [(1, PASSAGE), (2, PASSAGE.upper() + "and one more"), (3, None), (4, ""), (5, "short"), (None, PASSAGE),
             (6, "nowhere to be found in these rows at all"), (1, PASSAGE)]
    benchmark = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")

    def shingles(t):
        import re

        w = [x for x in re.split(r"[\x00-/:-`{-\x7f]+", (t or "").lower()) if x]
        return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    want = set()
    for d, t in ODD:
        for i, s in items:
            if d is not None and i is not None and (n := len(shingles(s))):
                both = len(shingles(t) & shingles(s))
                if both >= 0.8 * n - 1e-9:
                    want.add((d, i, n, both, both / n))
    got = rows(decontamination.contained(odd, benchmark))
    assert set(got) == want and len(got) == len(want) and want
    kept = Counter(r.doc_id for r in decontamination.clean(odd, benchmark).collect())
    assert kept == Counter(d for d, _ in ODD if d not in {w[0] for w in want})
    assert rows(decontamination.contained(nothing, benchmark)) == []
    empty = spark.createDataFrame([], benchmark.schema)
    assert rows(decontamination.contained(odd, empty)) == []
    assert decontamination.clean(odd, empty).count() == len(ODD)
    assert decontamination.clean(odd, empty).columns == odd.columns


def test_sketches_too_large_to_send_give_the_same(spark, monkeypatch):
    docs, items = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    want = set(rows(decontamination.contained(docs, items)))
    monkeypatch.setattr(decontamination, "SENT_VALUES", 0)
    assert set(rows(decontamination.contained(docs, items))) == want and want


def test_containment_is_native(spark):
    docs, items = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    plan = decontamination.contained(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


# ------------------------------------------------------------------ op10


def brute_classes(source):
    counts = [bag_minhash.shingle_counts(bag_minhash.words_of(t)) for _, t in source]
    up = list(range(len(source)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(source)):
        for j in range(i):
            both = (counts[i] & counts[j]).total()
            if counts[i] and both >= 0.8 * (counts[i].total() + counts[j].total() - both) - 1e-9:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(source):
        r = find(i)
        low[r] = min((x for x in (low.get(r), d) if x is not None), default=None)
    return Counter((d, low[find(i)]) for i, (d, _) in enumerate(source))


def near_copies():
    random = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    out = []
    for family in range(12):
        base = list(random.choice(words, 150))
        for copy in range(int(random.integers(1, 9)) if family else 40):
            text = list(base)
            for at in random.integers(0, 150, int(random.integers(0, 7))):
                text[at] = str(random.choice(words))
            out.append((len(out), " ".join(text)))
    return out + [(100 + len(out) + i, t) for i, (_, t) in enumerate(out[:50])]


def test_near_duplicates(spark, odd, nothing, tmp_path):
    source = near_copies()
    documents(spark, source).repartition(3).write.parquet(str(tmp_path / "d"))
    frame = spark.read.parquet(str(tmp_path / "d"))
    for docs, given_ in ((frame, source), (odd, ODD)):
        found = bag_minhash.classes(docs).collect()
        assert Counter((r.doc_id, r.class_id) for r in found) == brute_classes(given_)
        leaders = bag_minhash.keep_first(docs)
        assert leaders.columns == docs.columns
        assert leaders.count() == sum(r.leader for r in found)
    assert rows(bag_minhash.classes(nothing)) == []
    assert rows(bag_minhash.keep_first(nothing)) == []


def templates(pairs):
    """Texts that are near to each other, and in pairs near enough; few bands tell a pair apart."""
    own = lambda *x: " ".join(f"own{'x'.join(map(str, x))}x{i}" for i in range(17))
    shared = " ".join(f"template{i}" for i in range(150))
    return [(2 * k + j, f"{shared} pair{k} also{k} {own(k, j)}") for k in range(pairs) for j in range(2)]


@pytest.mark.parametrize("block, one_wave", [(1024, 100_000), (7, 10)])
def test_pairs_of_large_buckets_that_no_pivot_meets(spark, tmp_path, monkeypatch, block, one_wave):
    monkeypatch.setattr(bag_minhash, "BLOCK", block)
    monkeypatch.setattr(bag_minhash, "ONE_WAVE", one_wave)
    source = templates(40)
    documents(spark, source).repartition(3).write.parquet(str(tmp_path / "d"))
    found = bag_minhash.classes(spark.read.parquet(str(tmp_path / "d"))).collect()
    want = brute_classes(source)
    assert len({c for _, c in want}) == 40
    assert Counter((r.doc_id, r.class_id) for r in found) == want


def test_texts_just_under_the_threshold_do_not_meet_all_with_all(spark, tmp_path, monkeypatch):
    """Copies of one text with a few own words each: no two are linked, but their registers agree often."""
    random = np.random.default_rng(5)
    base, source = [f"base{i}" for i in range(300)], []
    for copy in range(80):
        text = list(base)
        for at in random.choice(np.arange(5, 295, 6), 7, replace=False):
            text[at] = f"own{copy}x{at}"
        source.append((copy, " ".join(text)))
    source.append((80, source[0][1] + " more"))
    compared, verified = [], bag_minhash.verified

    def counted(pairs, *given_):
        compared.append(pairs.count())
        return verified(pairs, *given_)

    monkeypatch.setattr(bag_minhash, "verified", counted)
    documents(spark, source).repartition(3).write.parquet(str(tmp_path / "d"))
    found = bag_minhash.classes(spark.read.parquet(str(tmp_path / "d"))).collect()
    assert Counter((r.doc_id, r.class_id) for r in found) == brute_classes(source)
    assert sum(compared[1:]) <= len(source), compared  # the first are pairs with pivots


def rows_of_left_joins(df):
    """Rows that the left joins of a plan make when it runs."""
    df.collect()

    def walk(node):
        children = node.children()
        below = [children.apply(i) for i in range(children.size())]
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            below.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            below.append(node.plan())
        made = "LeftOuter" in node.verboseString(1000) and node.nodeName().endswith("Join")
        return (node.metrics().get("numOutputRows").get().value() if made else 0) + sum(map(walk, below))

    return walk(df._jdf.queryExecution().executedPlan())


def test_labels_are_looked_up_once_per_text(spark, monkeypatch):
    """60 texts of two components share 32 large buckets each; a label is a text's, not a bucket's."""
    members = spark.createDataFrame([(r, k, 60) for r in range(60) for k in range(32)], "row long, key long, n long")
    labels = spark.createDataFrame([(r, r % 2) for r in range(58)], "node long, label long")
    made, stored = [], bag_minhash.stored

    def counted(df, what):
        made.append(rows_of_left_joins(df))
        return stored(df, what)

    monkeypatch.setattr(bag_minhash, "stored", counted)
    texts = bag_minhash.mixed_texts(members, labels)
    made.append(rows_of_left_joins(texts))
    assert sorted((r.row, r.label) for r in texts.collect()) == [(r, r % 2 if r < 58 else r) for r in range(60)]
    assert 0 < sum(made) <= 60, made


def test_rows_are_the_same_when_splits_change(spark, tmp_path, monkeypatch):
    """As after an executor is lost or registered, each job deals the table to other tasks."""
    source = near_copies()[:40]
    documents(spark, source).repartition(6).write.parquet(str(tmp_path / "d"))
    sizes, size_key = iter(["64k", "128m"] * 500), "spark.sql.files.maxPartitionBytes"

    def change_before(f):
        def changed(*given, **named):
            spark.conf.set(size_key, next(sizes))
            return f(*given, **named)

        return changed

    for module in (bag_minhash, repeats):
        monkeypatch.setattr(module, "stored", change_before(module.stored))
    try:
        frame = spark.read.parquet(str(tmp_path / "d"))
        found = bag_minhash.classes(frame).collect()
        assert Counter((r.doc_id, r.class_id) for r in found) == brute_classes(source)
        assert Counter(rows(repeats.digest(repeats.without_repeats(frame)))) == without_repeats(source)
    finally:
        spark.conf.unset(size_key)


def test_registers_estimate_weighted_similarity():
    random = np.random.default_rng(4)
    hashes = random.integers(0, 2**63, 60).astype(np.uint64)
    one, two = random.integers(0, 9, 60), random.integers(0, 9, 60)
    owner = np.r_[np.zeros(60, int), np.ones(60, int)]
    weights = np.r_[one, two]
    keep = weights > 0
    registers = bag_minhash.signatures(owner[keep], np.r_[hashes, hashes][keep], weights[keep], 2, m=20000)
    want = np.minimum(one, two).sum() / np.maximum(one, two).sum()
    assert abs((registers[0] == registers[1]).mean() - want) < 0.02


def test_shingle_hashes_are_of_the_words():
    hasher = bag_minhash.ShingleHashes()
    a, b = hasher.of("x a b c d e y".split()), hasher.of("longer start a b c d e".split())
    assert a[1] == b[2] and len(set(a.tolist() + b.tolist())) == len(a) + len(b) - 1
    assert len(hasher.of(["one"])) == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201)]
    got = dict(rows(components(spark.createDataFrame(edges, "a long, b long"))))
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160)) and got[201] == 200


def test_a_local_folder_only_on_one_machine():
    from tallywright.llm.common import one_machine

    assert one_machine("local") and one_machine("local[8]") and one_machine("local[*]")
    for master in ("local-cluster[3,2,3000]", "yarn", "spark://host:7077", "k8s://https://host"):
        assert not one_machine(master)
