"""Exact dedup and the n-gram join against brute force; nulls, ties, repeated rows, extra columns, empty tables."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from latticework.llm import common as C
from latticework.llm import ngram_join as J
from latticework.llm.components import connected_components
from latticework.llm.exact_dedup import ORACLE, exact_duplicates

DOCS = "doc_id long, text string, source string, size long, run string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "s", 1, "x") for i, t in texts], DOCS)


def brute_links(texts, k=5, percent=80):
    def shingles(t):
        w = re.findall(C.WORD, (t or "").translate(str.maketrans(C.ASCII_UPPER, C.ASCII_LOWER)))
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t in texts]
    comp = list(range(len(texts)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                comp[find(i)] = find(j)
    out = {}
    for i, (d, _) in enumerate(texts):
        ids = [x for j, (x, _) in enumerate(texts) if find(j) == find(i) and x is not None]
        out.setdefault(d, []).append((len(sets[i]), min(ids) if ids else None))
    return {d: sorted(v, key=str) for d, v in out.items()}


def near_copies(seed, n):
    r = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(300)]
    bases = [[r.choice(vocabulary) for _ in range(r.choice((3, 8, 40, 120)))] for _ in range(n // 6)]
    passage = [r.choice(vocabulary) for _ in range(30)]
    out = []
    for i in range(n):
        w = list(r.choice(bases))
        for _ in range(r.choice((0, 0, 1, 1, 2, 4))):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        if r.random() < 0.2:
            w += passage
        out.append((i * 3 % 1009, r.choice((" ", "\n", " \t ")).join(w)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_ngram_join_is_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 8)  # several blocks per shingle, too
    texts = near_copies(seed, 150)
    got = {}
    for r in J.ngram_jaccard_components(docs(spark, texts)).collect():
        got.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
    assert {d: sorted(v, key=str) for d, v in got.items()} == brute_links(texts)


def test_ngram_links_are_brute_force(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 8)
    texts = near_copies(5, 120)
    texts += [(None, texts[0][1]), (None, texts[1][1] + " own"), (None, texts[1][1] + " own"), (texts[2][0], texts[3][1]), (2000, None), (2001, " ")]
    sets = []
    for _, t in texts:
        w = re.findall(C.WORD, (t or "").translate(str.maketrans(C.ASCII_UPPER, C.ASCII_LOWER)))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else []))
    linked = lambda a, b: len(a & b) and 100 * len(a & b) >= 80 * len(a | b)
    want = sorted((str(d), len(s), sum(1 for j, o in enumerate(sets) if j != i and linked(s, o))) for i, ((d, _), s) in enumerate(zip(texts, sets)))
    got = J.ngram_jaccard_components(docs(spark, texts), links=True).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.n_links) for r in got) == want
    different = list(dict.fromkeys(sets))
    rows = J.ngram_jaccard_links(docs(spark, texts)).collect()
    assert len(rows) == sum(1 for i, a in enumerate(different) for b in different[:i] if linked(a, b))
    assert sum(2 * r.a_rows * r.b_rows for r in rows) == sum(n for _, _, n in want) - sum(1 for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and a and a == b)


def test_chain_over_a_row_without_an_id(spark):
    w = [f"c{i}" for i in range(60)]
    texts = [(1, " ".join(w)), (None, " ".join(w[4:] + ["x1", "x2", "x3", "x4"])), (2, " ".join(w[8:] + ["x1", "x2", "x3", "x4", "y1", "y2", "y3", "y4"]))]
    got = {r.doc_id: (r.component_id, r.n_links) for r in J.ngram_jaccard_components(docs(spark, texts), links=True).collect()}
    assert got == {1: (1, 1), None: (1, 2), 2: (1, 1)}


def test_ngram_join_odd_rows(spark):
    texts = [(1, None), (2, ""), (3, " \n "), (4, "A b"), (5, "a  B"), (6, "a b c"), (7, "long " * 30_000), (8, "Long " * 9), (None, "a b"), (None, "only one here of all"), (9, "x y z u v"), (9, "x y z u v")]
    got = {}
    for r in J.ngram_jaccard_components(docs(spark, texts)).collect():
        got.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
    assert {d: sorted(v, key=str) for d, v in got.items()} == brute_links(texts)


def test_ngram_join_of_chunks_with_the_same_rows(spark):
    texts = near_copies(3, 24) + [(None, "a b c d e f"), (5000, "long " * 700_000)]
    d = docs(spark, texts).coalesce(1)
    rows = J.ngram_jaccard_components(d.union(d).union(d)).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
    assert len(rows) == 3 * len(texts)
    assert {d: sorted(v, key=str) for d, v in got.items()} == brute_links(texts * 3)


def test_ngram_join_empty(spark):
    out = J.ngram_jaccard_components(docs(spark, []))
    assert out.columns == ["doc_id", "n_shingles", "component_id"] and out.count() == 0


def test_group_of_near_copies_costs_its_size(spark):
    """A family whose members differ in pairs: all are found, though no pair list is made."""
    base = [f"t{i}" for i in range(200)]
    texts = []
    for i in range(120):
        w = list(base)
        w[i] = f"own{i}"
        texts.append((i, " ".join(w)))
    assert {r.component_id for r in J.ngram_jaccard_components(docs(spark, texts)).collect()} == {0}


def test_connected_components_over_several_tasks(spark, monkeypatch):
    from latticework.llm import components

    monkeypatch.setattr(components, "EDGES_PER_TASK", 20)
    r = random.Random(4)
    edges = [(r.randrange(90), r.randrange(90)) for _ in range(70)]
    label = list(range(90))
    for _ in range(90):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {x.id: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {i: label[i] for e in edges for i in e if e[0] != e[1]}


def exact(spark, texts, **how):
    return sorted(exact_duplicates(docs(spark, texts).repartition(11), **how).collect(), key=str)


@pytest.mark.parametrize("fan_in", [2, 3, 8])
def test_exact_dedup_is_sql(spark, fan_in):
    r = random.Random(fan_in)
    texts = [(i, r.choice(("a", "A", "", None, "a ", "é", "x" * 100_000, f"t{i % 40}"))) for i in range(200)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", texts)
    want = sorted(con.execute(ORACLE).fetchall(), key=lambda r: r[0])
    assert sorted((tuple(r) for r in exact(spark, texts, fan_in=fan_in)), key=lambda r: r[0]) == want


def test_exact_dedup_odd_rows(spark):
    rows = exact(spark, [(5, "a"), (5, "a"), (None, "a"), (None, "b"), (1, None), (2, "")])
    assert sum(r.kept for r in rows) == 3
    assert {(r.doc_id, r.keep_id, r.group_size) for r in rows} == {(5, 5, 3), (None, 5, 3), (None, None, 1), (1, 2, 2), (2, 2, 2)}
    assert {r.keep_id for r in exact(spark, [(3, "a"), (7, "a")], keep="smallest")} == {3}
    assert exact(spark, []) == []


def test_lower_case_is_ascii_only(spark):
    assert spark.range(1).select(C.ascii_lower(F.lit("AZÉ"))).first()[0] == "azÉ"


def test_a_task_tried_again_sees_the_same_rows(spark, tmp_path):
    """Only an input that comes from a shuffle is written first; both give every row its set."""
    r = random.Random(21)
    rows = [(i % 40, " ".join(f"w{r.randrange(30)}" for _ in range(12))) for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    scan = spark.read.parquet(f"{tmp_path}/d")
    moved = scan.repartition(5)
    assert C.stable(scan) is scan and C.stable(moved)._staged_at
    twice = scan.union(scan)
    key = lambda df: sorted(tuple(x) for x in J.ngram_jaccard_components(df).collect())
    assert key(moved) == key(scan) and key(twice) == sorted(key(scan) * 2)
