"""Phrase collocations (op11), whitening (op12) and line dedup (op13) against brute force."""

from __future__ import annotations

import hashlib
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

from tallywright.llm import line_dedup, phrases, queries, whitening  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, _d long, _k string, kept string, rank int"
BOILER = "Subscribe to our newsletter for more"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, "x", "y", 3) for i, t, lang in rows], SCHEMA)


# ------------------------------------------------------------------ op13


def brute_lines(rows):
    split = {i: ("" if t is None else t).split("\n") for i, t, _ in rows}
    white = " \t\n\x0b\x0c\r"
    key = {}
    holders = defaultdict(set)
    for idx, (i, t, _) in enumerate(rows):
        for line in ("" if t is None else t).split("\n"):
            k = line.strip(white).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            key[line] = k
            if i is not None and len(k) >= 20:
                holders[k].add(i)
    out = []
    for i, t, _ in rows:
        lines = ("" if t is None else t).split("\n")
        keep = [
            line for line in lines
            if i is None or len(holders.get(key[line], ())) < 3 or max(holders[key[line]]) == i
        ]
        out.append((i, len(lines), len(lines) - len(keep), hashlib.sha256("\n".join(keep).encode()).hexdigest()))
    del split
    return sorted(out, key=repr)


LINE_ROWS = [
    (1, f"{BOILER}\nfirst article line here\n  {BOILER.upper()}  ", "en"),
    (2, f"intro\n{BOILER}\n{BOILER}\nbody", "en"),
    (3, f"{BOILER}\r", "fr"),
    (3, f"{BOILER}\r", "fr"),
    (4, "short\nshort\nshort", None),
    (5, None, "en"),
    (6, "", "en"),
    (None, f"{BOILER}\nno id", "en"),
    (7, "two docs only share this line\nx", "en"),
    (8, "two docs only share this line", "en"),
    (9, ("very long line " * 5000) + "\n" + BOILER, "de"),
]


def test_line_dedup_matches_brute_force(spark):
    got = line_dedup.digest(line_dedup.kept_texts(documents(spark, LINE_ROWS)))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_lines(LINE_ROWS)


def test_line_dedup_keeps_largest_holder_and_runs(spark):
    found = {r["doc_id"]: r for r in line_dedup.kept_texts(documents(spark, LINE_ROWS)).collect() if r["doc_id"]}
    assert found[9]["n_dropped"] == 0  # the largest holder keeps its line
    assert [tuple(x) for x in found[2]["dropped"]] == [(1, 2)]  # one run of two lines
    assert found[2]["kept"] == "intro\nbody"
    assert found[1]["_d"] == 1 and found[1]["rank"] == 3  # clashing columns pass through


def test_line_dedup_is_native_and_handles_empty(spark):
    plan = line_dedup.kept_texts(documents(spark, LINE_ROWS))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert line_dedup.digest(line_dedup.kept_texts(documents(spark, []))).count() == 0


def test_line_dedup_query_equals_sql(spark):
    import duckdb

    data = "/root/testdata/sf0.001"
    ours = sorted(tuple(r) for r in queries.op13_line_dedup(spark, data).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    assert ours == sorted(con.execute(queries.SQL["op13_line_dedup"]).fetchall())


# ------------------------------------------------------------------ op11


def brute_phrases(rows, least=30, top=2000):
    grams = defaultdict(Counter)
    for _, t, lang in rows:
        lang = lang or "und"
        text = ("" if t is None else t).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            for n in range(1, 5):
                for i in range(len(w) - n + 1):
                    grams[lang][tuple(w[i:i + n])] += 1
    out = []
    for lang, f in grams.items():
        total = sum(c for g, c in f.items() if len(g) == 1)
        cands = {g: c for g, c in f.items() if len(g) >= 2 and c >= least}
        kept = []
        for g, a in cands.items():
            if any(len(h) > len(g) and 100 * b >= 80 * a and any(h[i:i + len(g)] == g for i in range(len(h) - len(g) + 1))
                   for h, b in cands.items()):
                continue
            score, k, l, r = min((2000000 * a // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            kept.append((-score, -a, " ".join(g).encode(), " ".join(g), a, l, r, score))
        kept.sort()
        out += [(lang, i + 1, p, a, l, r, total, s) for i, (_, _, _, p, a, l, r, s) in enumerate(kept[:top])]
    return sorted(out)


def phrase_rows():
    rng = np.random.default_rng(7)
    vocab = ["new", "york", "city", "of", "the", "Big", "apple", "is", "fine", "très", "bien", "ß"]
    rows = []
    for i in range(120):
        words = [vocab[j] for j in rng.integers(0, len(vocab), 30)]
        rows.append((i, " ".join(words) + ". New York City is big; the big apple!", "en" if i % 3 else None))
    return rows + [(500, None, "en"), (501, "", None), (502, "new\tyork " * 40, "en")]


def test_phrases_match_brute_force(spark):
    rows = phrase_rows()
    got = phrases.collocations(documents(spark, rows)).drop("cut")
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(rows)


def test_phrases_top_is_a_limit_and_empty_table(spark):
    rows = phrase_rows()
    got = phrases.collocations(documents(spark, rows), top=3).collect()
    assert sorted((r["lang"], r["rank"]) for r in got) == sorted((lang, k) for lang in ("en", "und") for k in (1, 2, 3))
    assert phrases.collocations(documents(spark, [])).count() == 0


def records_shuffled(df):
    df.collect()

    def walk(node):
        children = node.children()
        below = [children.apply(i) for i in range(children.size())]
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            below.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            below.append(node.plan())
        own = node.metrics().get("shuffleRecordsWritten").get().value() if kind == "ShuffleExchangeExec" else 0
        return own + sum(map(walk, below))

    return walk(df._jdf.queryExecution().executedPlan())


def test_rare_phrases_of_frequent_words_are_not_shuffled_as_strings(spark, monkeypatch):
    """Each of 150 words is frequent, hardly a pair of them is: only what is frequent is sent by its words."""
    rng = np.random.default_rng(11)
    rows = [(i, " ".join(f"w{j}" for j in rng.integers(0, 150, 60)) + ". new york city", "en") for i in range(200)]
    sent, stored = [], phrases.stored

    def counted(df, what):
        sent.append(records_shuffled(df))
        return stored(df, what)

    monkeypatch.setattr(phrases, "stored", counted)
    got = phrases.collocations(documents(spark, rows)).drop("cut")
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(rows)
    assert 0 < sum(sent) < 2000, sent


def test_long_texts_are_cut_where_no_phrase_is(monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 100)
    text = "one two\tThree. four,five  six\n" * 30 + "and no end " * 40
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "fr", "en"]), pa.array([text, text, None])], names=["lang", "text"])
    found = list(phrases.blocks(iter([batch])))
    assert len(found) > 10
    for n in (1, 2, 4):
        got = Counter()
        for block in found:
            for g, f in zip(*block.counted(block.numbers(), block.starts(n), n)):
                got[block.lang, g] += f
        pieces = [x.lower().split() for x in re.split(r"[.,\n]", text)]
        want = Counter(" ".join(w[i : i + n]) for w in pieces for i in range(len(w) - n + 1))
        assert got == {(lang, g): f for lang in ("en", "fr") for g, f in want.items()}


def test_phrases_of_several_sendings_and_languages(spark, monkeypatch):
    rows = phrase_rows() + [(600 + i, "a b c d. E f  g\th", f"long-language-{i % 2}") for i in range(80)]
    monkeypatch.setattr(phrases, "HELD_HASHES", 50)
    monkeypatch.setattr(phrases, "HELD_PHRASES", 20)
    got = phrases.collocations(documents(spark, rows)).drop("cut")
    assert sorted(tuple(r) for r in got.collect()) == brute_phrases(rows)


# ------------------------------------------------------------------ op12


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, x string")


def test_whitening_matches_numpy(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 6)) @ rng.normal(size=(6, 6))
    rows = [(i, [float(v) for v in base[i]], 1, "a") for i in range(300)]
    rows += [(900, None, 1, "a"), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1, "a"), (902, [float("nan")] * 6, 1, "a"),
             (903, [1.0, 2.0], 1, "a"), (None, [float(v) for v in base[0]], 1, "a")]
    got = whitening.whiten(vectors(spark, rows)).toPandas()
    fit = np.array([r[1] for r in rows[:300]] + [rows[0][1]], dtype=np.float32).astype(np.float64)
    X = np.floor(fit * 64) + 1_000_000
    n, S = len(X), X.sum(axis=0)
    V = np.cov(X.T, bias=True)
    w, U = np.linalg.eigh(V)
    w, U = w[::-1], U[:, ::-1]
    assert set(got.component) == set(range(1, 7)) and (got.n == n).all()
    assert got.identity_error.max() < 1e-9
    for k in range(6):
        part = got[got.component == k + 1]
        assert abs(part.explained.iloc[0] - w[k] / np.trace(V)) < 1e-9
        mine = part[part.vec_id.notna()].set_index("vec_id").whitened.loc[range(300)].values
        theirs = ((X[:300] - S / n) @ U[:, k]) / np.sqrt(w[k])
        assert min(abs(mine - theirs).max(), abs(mine + theirs).max()) < 1e-8
    dev = got[got.component == 1].set_index("vec_id").deviation
    assert dev.loc[5] == sum(int(v) ** 2 for v in (n * X[5] - S).astype(np.int64))


def test_whitening_clustered_eigenvalues():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.normal(size=(8, 8)))
    a = q @ np.diag([5, 5, 5, 2, 2, 1, 1e-3, 1e-3]) @ q.T
    lam, x = whitening.refined_eigen(a)
    assert np.abs(x.T @ x - np.eye(8)).max() < 1e-13
    assert np.abs(a @ x - x * lam).max() < 1e-12
    assert np.allclose(lam, [5, 5, 5, 2, 2, 1, 1e-3, 1e-3])


def test_whitening_empty(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None, 1, "a")])).count() == 0
