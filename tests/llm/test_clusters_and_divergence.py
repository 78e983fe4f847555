"""Clustering and the audit of sources against brute force and SQL."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SMALL, same_rows

from lectern.llm import centroid_clusters as cc
from lectern.llm import source_divergence as sd
from lectern.llm.queries import ORACLES, QUERIES

MIDDLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def middle():
    import duckdb

    found = duckdb.connect()
    for name in ("documents", "embeddings"):
        found.sql(f"create view {name} as select * from '{MIDDLE}/{name}.parquet'")
    return found


@pytest.mark.parametrize("name", ["op11_block_norms", "op12_source_divergence"])
def test_query_equals_sql(spark, oracle, middle, name):
    for folder, db in ((SMALL, oracle), (MIDDLE, middle)):
        got = QUERIES[name](spark, folder).toPandas().drop(columns="n_exact", errors="ignore")
        assert len(got)
        same_rows(got, db.sql(ORACLES[name]).df())


def test_query_has_the_columns_of_its_sql(spark, oracle):
    assert QUERIES["op11_block_norms"](spark, SMALL).columns == oracle.sql(ORACLES["op11_block_norms"]).columns


# --- clustering ---


def clusters(rows, k, rounds, size, scale=64):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    centroids = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for r in range(rounds + 1):
        given = [min((gap(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
        for j in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(kept, given) if c == j]
            if own and r < rounds:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    inertia = Counter()
    for d, j in given if kept else ():
        inertia[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), digest[j]) for (i, _), (d, j) in zip(kept, given)), key=str) if kept else []


@pytest.mark.parametrize("size,k", [(3, 4), (8, 2), (11, 16)])
def test_clusters(spark, size, k):
    rng = random.Random(size)
    vector = lambda s=1.0: [rng.gauss(0, s) for _ in range(size)]
    same = vector()
    rows = [(n, vector(rng.choice((0.01, 1, 300)))) for n in range(60)] + [(100 + n, same) for n in range(20)] + [(7, same), (7, vector()), (None, vector()), (None, [0.0] * size)]
    rows += [(200, None), (201, []), (202, vector()[1:]), (203, vector() + [0.0]), (204, [None, *vector()[1:]]), (205, [math.nan, *vector()[1:]]), (206, [math.inf, *vector()[1:]]), (207, [-0.0] * size)]
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, vector int").repartition(4)
    got = cc.cluster_vectors(table, k=k, size=size).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == clusters(rows, k, 3, size)
    assert all(1 <= r.n_exact <= k for r in got)


def test_few_and_no_vectors(spark):
    table = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    got = cc.cluster_vectors(table, k=16, size=2).collect()
    assert {(r.cluster, r.distance, r.inertia) for r in got} == {(0, 0, 0)} and len(got) == 2
    assert cc.cluster_vectors(table, k=16, size=64).count() == 0
    assert cc.cluster_vectors(table.limit(0), size=2).columns == cc.cluster_vectors(table, size=2).columns
    with pytest.raises(Exception, match="would not fit"):
        cc.cluster_vectors(spark.createDataFrame([(1, [1e9, 0.5])], table.schema), size=2).count()


def test_screening_is_exact_and_prunes():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 20, (16, 64))
    vectors = np.floor(centres[rng.integers(0, 16, 3000)] + rng.normal(0, 4, (3000, 64))).astype(np.int64)
    centroids = np.floor(centres).astype(np.int64)
    centroids[9] = centroids[4]  # of two equal ones the first is taken
    cluster, distance, tried = cc.nearest(vectors, *cc.compress(vectors), centroids)
    full = ((vectors[:, None] - centroids) ** 2).sum(axis=2)
    assert (cluster == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
    assert tried.mean() < 3
    for rows in (np.zeros((5, 64), np.int64), np.full((3, 64), cc.LARGEST), rng.integers(-3, 4, (400, 64))):
        cluster, distance, _ = cc.nearest(rows, *cc.compress(rows), centroids)
        full = ((rows[:, None] - centroids) ** 2).sum(axis=2)
        assert (cluster == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()


# --- divergence ---


def audit(rows, least, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    rows = [(lang or "", source or "", term.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    df, counts = Counter(), defaultdict(Counter)
    for lang, source, terms in rows:
        df.update((lang, t) for t in set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang in {r[0] for r in rows}:
        kept = [t for (own, t), n in df.items() if own == lang and n >= least]
        sources = [s for own, s in counts if own == lang]

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            best = [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", best)):
                order = sorted(found, key=lambda r: (-r[1], r[0].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(order) if part == "pair" or k < top]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 5) for r in rows], "lang string, source string, text string, n int, term string, salt int").repartition(5)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    words = ["the", "The", "\u00c9t\u00e9", "\u65e5\u672c", "a", "b", "ab", "abc", "x1y", "don't", "\U0001f600", "caf\u00e9", "CAF\u00c9", "zz\u2019zz"] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(80)]
    text = lambda: "".join(rng.choice(words[: rng.choice((5, 20, 94))]) + rng.choice((" ", "\n", ",", "\x00", "_", "  ")) for _ in range(rng.randrange(60)))
    out = [(rng.choice(("en", "en", "de", None)), rng.choice(("s0", "s0", "s1", "s2", "", None)), text()) for _ in range(300)]
    return out + [("en", "s9", None), ("fr", "s1", ""), ("fr", "s2", "one two"), ("fr", "s2", "one two"), ("en", "long", "the abc " * 300_000), ("en", "run", "q" * 3_000_000), ("en", "run", "q" * 3_000_000 + " w"), ("en", "s0", "\u00e9" * 129 + " " + "\u00e9" * 128), ("xx", "only", "a a a")]


@pytest.mark.parametrize("least,top", [(1, 3), (5, 50), (1000, 50)])
def test_audit(spark, rows, least, top):
    got = sd.audit_sources(table(spark, rows), least=least, top=top).collect()
    assert sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in got) == audit(rows, least, top)


def test_audit_in_small_steps(spark, rows, monkeypatch):
    """Many automata, flushes and blocks of pairs give the same."""
    want = audit(rows[:200], 3, 50)
    docs = table(spark, rows[:200])
    monkeypatch.setattr(sd, "BLOCK", 100)
    got = sd.audit_sources(docs, least=3).collect()
    assert sorted(tuple(r) for r in got) == want


def test_pairs_in_blocks(monkeypatch):
    import pyarrow as pa

    rng = random.Random(5)
    terms = [(rng.choice("ab"), [{"source": f"s{k}", "p": rng.randrange(9), "z": k + 1} for k in rng.sample(range(30), rng.randrange(1, 30))]) for _ in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array([t[0] for t in terms]), pa.array([t[1] for t in terms], pa.list_(pa.struct([("source", pa.string()), ("p", pa.int64()), ("z", pa.int64())])))], ["lang", "entries"])
    want = Counter()
    for lang, own in terms:
        for x in own:
            for y in own:
                if x is not y:
                    want[lang, x["source"], y["source"]] += abs(x["p"] - y["p"]) - abs(x["p"] - y["z"]) - abs(x["z"] - y["p"]) + abs(x["z"] - y["z"])
    for size in (1, 50, 1 << 20):
        monkeypatch.setattr(sd, "PAIRS", size)
        got = Counter()
        for part in sd._shared_parts(iter([batch, batch.slice(0, 0)])):
            for r in part.to_pylist():
                got[r["lang"], r["source"], r["item"]] += r["value"]
        assert got == want


def test_counts_are_handed_on(rows, monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"lang": [r[0] or "" for r in rows], "text": [r[2] or "" for r in rows]})
    total = lambda: sum((Counter({(r["lang"], r["term"]): r["n"]}) for part in sd._document_counts(iter([batch])) for r in part.to_pylist()), Counter())
    want = total()
    monkeypatch.setattr(sd, "KEYS", 10)
    assert total() == want


def test_no_documents(spark, rows):
    assert sd.audit_sources(table(spark, rows).limit(0)).count() == 0
