"""URL reputation, mixing, packing, archives, and the pipeline."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.llm import packing as P
from latticework.llm import url_reputation as U
from latticework.llm import warc as W
from latticework.llm.source_mixing import mix_sources, targets


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


# ---------------------------------------------------------------- urls


def test_hosts_paths_and_rules(spark):
    urls = {
        1: ("http://A.Example.com/en/7x?q#f", "a.example.com", "/en/7x", "example.com/en/7"), 2: ("https://b.com/en/1", "b.com", "/en/1", "com/en/"), 3: (None, "", "", None),
        4: ("no scheme.com/en/", "", "", None), 5: ("x://y.net?/de/", "y.net", "", None), 6: ("x://example.net/de/81://z", "example.net", "/de/81://z", "example.net/de/8"),
        7: ("x://notexample.net/de/8", "notexample.net", "/de/8", "net/de/"), 8: ("x://org/es/", "org", "/es/", "org/es/"), 9: ("x://", "", "", None),
    }
    pages = spark.createDataFrame([(i, u[0], "b") for i, u in urls.items()], "page_id long, url string, bad string")
    got = U.filter_urls(pages, spark.createDataFrame([], "page_id long, bad int")).collect()
    assert {r.page_id: (r.host, r.path, r.rule) for r in got} == {i: u[1:] for i, u in urls.items()}
    assert {r.page_id for r in got if r.verdict == "block"} == {2, 6, 8}
    assert U.filter_urls(pages.where(F.lit(False)), spark.createDataFrame([(1, 1)], "page_id long, bad int")).count() == 0


def test_beta_quantiles(spark):
    r = np.random.default_rng(1)
    cases = [(1.0, 1.0), (2.0, 5.0), (0.5, 0.5), (40.0, 3.0), (3000.0, 9000.0), (0.05, 20.0)]
    d = spark.createDataFrame(cases, "a double, b double").withColumn("q", U.beta_quantile(F.col("a"), F.col("b"), 0.05))
    for x in d.collect():
        assert x.q == pytest.approx(np.quantile(r.beta(x.a, x.b, 400_000), 0.05), abs=0.006)


def test_repeated_pages_and_null_ids_keep_their_rows(spark):
    rows = [(1, "http://a.com/x")] * 3 + [(None, "http://a.com/x"), (None, None), (2, "")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit(1) for c in ("host", "bad", "verdict", "n")})
    out = U.filter_urls(pages, spark.createDataFrame([(1, 1), (1, 0), (None, 1)], "page_id long, bad int")).collect()
    assert sorted((r.page_id or 0, r.host) for r in out) == [(0, ""), (0, "a.com"), (1, "a.com"), (1, "a.com"), (1, "a.com"), (2, "")]


def test_reputation_shrinks_and_blocks(spark):
    rows = [(h, i, f"http://h{h}.d{h % 4}.io/x") for h in range(12) for i in range(40)]
    bad = lambda h, i: int(i < 38) if h == 5 else int(i < 2)
    pages = spark.createDataFrame([(h * 100 + i, u) for h, i, u in rows] + [(5000, "http://new.d1.io/"), (5001, "http://h5.d1.io/y")], "page_id long, url string")
    out = U.filter_urls(pages, spark.createDataFrame([(h * 100 + i, bad(h, i)) for h, i, _ in rows], "page_id long, bad int")).collect()
    host = {r.host: r for r in out}
    assert {r.host for r in out if r.verdict == "block"} == {"h5.d1.io"}
    assert 0.5 < host["h5.d1.io"].bad_rate < 38 / 40 and host["new.d1.io"].bad_rate > host["h0.d0.io"].bad_rate
    assert host["new.d1.io"].labelled == 0


# ---------------------------------------------------------------- mixing


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        free = sum(w[s] for s in names if s not in capped)
        t = {s: most * sizes[s] if s in capped else rest * w[s] / free for s in names}
        over = {s for s in names if t[s] > most * sizes[s]} - capped
        if not over:
            return t
        capped |= over


@pytest.mark.parametrize("seed", range(4))
def test_targets_are_reshared(spark, seed):
    r = random.Random(seed)
    sizes = {s: r.choice((0, 1, 10, 100, 5000)) for s in [*"abcdefgh", "é", None]}
    got = targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long"))
    assert {x.source: x.target for x in got.collect()} == pytest.approx(plain_targets(sizes))


def test_mix_comes_near_its_targets(spark):
    r = random.Random(3)
    rows = [(i, " ".join(["w"] * r.randrange(1, 40)), r.choice(["a", "b", "b", "b", "c", None]), 7) for i in range(3000)] + [(5000, None, "b", 1), (5001, "", "d", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, size long")
    out = mix_sources(d).collect()
    assert len(out) == len(rows)
    sums = {}
    for x in out:
        s = sums.setdefault(x.source, [0, x.target, x.source_size])
        s[0] += x.taken
        assert x.taken == x.copies * x.size <= 3 * x.size
    assert sum(s[1] for s in sums.values()) == pytest.approx(sum(s[2] for s in sums.values()))
    assert all(abs(taken - target) <= 40 for taken, target, _ in sums.values())
    again = {x.doc_id: x.taken for x in mix_sources(d.repartition(5)).collect()}
    assert again == {x.doc_id: x.taken for x in out}
    assert mix_sources(d.where(F.lit(False))).count() == 0


def test_shorter_documents_are_likelier(spark):
    d = spark.createDataFrame([(i, "w " * (2 if i % 2 else 60), "ab"[i % 7 == 0]) for i in range(6000)], "doc_id long, text string, source string")
    rate = {r["size"]: r.c for r in mix_sources(d).where("source = 'a' or source = 'b'").groupBy("size").agg(F.avg("copies").alias("c")).collect()}
    assert rate[2] > rate[60]


# ---------------------------------------------------------------- packing


def test_fast_ids_are_those_of_tokenizers(tokenizer):
    from tokenizers import Tokenizer

    whole, fast = Tokenizer.from_file(tokenizer), P.encoder(tokenizer)
    r = random.Random(1)
    alphabet = [*"aZé 'ſ中\n\t\x00\u3000👍²٣", "'ll", "  ", "<|endoftext|>", "don't", "12345", "\r\n", "\u200d"]
    for text in ["", " ", "x" * 5000, *["".join(r.choice(alphabet) for _ in range(r.randrange(80))) for _ in range(300)]]:
        assert list(fast(text)) == whole.encode(text, add_special_tokens=False).ids


def test_fullest_is_best_of_all():
    import itertools

    r = random.Random(2)
    for _ in range(60):
        counts = np.zeros(31, np.int64)
        for _ in range(r.randrange(1, 6)):
            counts[r.randrange(1, 20)] += r.randrange(1, 4)
        own = [n for n in range(31) for _ in range(counts[n])]
        best = max(s for k in range(len(own) + 1) for c in itertools.combinations(own, k) if (s := sum(c)) <= 25)
        got = P.fullest(counts, 25)
        assert sum(a * b for a, b in got) == best and all(b <= counts[a] for a, b in got)


def best_fit_decreasing(histogram, capacity):
    room = [0] * (capacity + 1)  # bins by free space
    n = 0
    for length in sorted((a for a, b in histogram.items() for _ in range(b)), reverse=True):
        k = next((k for k in range(length, capacity + 1) if room[k]), None)
        if k is None:
            n, k = n + 1, capacity
        else:
            room[k] -= 1
        room[k - length] += 1
    return n


def test_bins_hold_all_pieces_once():
    r = random.Random(5)
    histogram = {r.randrange(1, 101): r.randrange(1, 500) for _ in range(60)}
    bins = P.minimum_bin_slack(histogram, 100)
    used = {}
    for times, inside in bins:
        assert sum(a * b for a, b in inside) <= 100
        for a, b in inside:
            used[a] = used.get(a, 0) + b * times
    assert used == histogram
    assert sum(t for t, _ in bins) <= 1.01 * best_fit_decreasing(histogram, 100)


def test_packing_is_gapless_and_whole(spark, tokenizer):
    from tokenizers import Tokenizer

    r = random.Random(6)
    texts = {i: None if i == 0 else "" if i == 1 else "word salad " * r.choice((1, 3, 10, 60, 700)) for i in range(150)}
    d = spark.createDataFrame([(i, t, 5) for i, t in texts.items()] + [(7, texts[7], 5)], "doc_id long, text string, length long").repartition(6)
    rows = P.pack_documents(d, tokenizer, capacity=256, with_ids=True).collect()
    whole, by_doc, by_seq = Tokenizer.from_file(tokenizer), {}, {}
    for x in rows:
        by_doc.setdefault(x.doc_id, []).append(x)
        by_seq.setdefault(x.sequence_id, []).append((x.offset, x.length))
        assert x.ids_crc32 == zlib.crc32(np.array(x.ids, "<u4").tobytes()) and len(x.ids) == x.length
    for i, t in texts.items():
        ids = whole.encode(t or "", add_special_tokens=False).ids + [2]
        own = sorted(by_doc[i], key=lambda x: x.piece)[:: 2 if i == 7 else 1]
        assert [k for x in own for k in x.ids] == ids and (len(ids) > 256) == (len(own) > 1) and all(x.length == 256 for x in own[1:])
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert P.pack_documents(d.where(F.lit(False)), tokenizer).count() == 0


# ---------------------------------------------------------------- archives


def test_archive_round_trip(spark):
    html = {1: "<p>é</p>" * 50, 2: None, 3: "", 4: "same", 5: "same", 6: "x" * 200_000, 7: "same", None: "nobody"}
    d = spark.createDataFrame([(i, None if i == 4 else f"http://h/{i}\r\nX: 1", h, "n") for i, h in html.items()], "page_id long, url string, html string, n string")
    got = {r.page_id: r for r in W.archive_pages(d).collect()}
    assert len(got) == len(html)
    for i, h in html.items():
        payload = (h or "").encode()
        best = max((j for j, x in html.items() if j is not None and (x or "") == (h or "")), default=None)
        want = ("response", None) if i == best or best is None else ("revisit", best)
        assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == (len(payload), W.digest32(payload), *want)
    again = W.archive_pages(d, least_bytes=5)
    assert {r.page_id for r in again.collect() if r.record_type == "revisit"} == set()
    assert W.archive_pages(d.where(F.lit(False))).count() == 0


def test_reader_refuses_damage():
    import zstandard

    ok = W.record_bytes(1, "u", "response", b"abc", W.digest32(b"abc"), 3, None)
    frame = zstandard.ZstdCompressor().compress(ok)
    assert [b for _, b in W.read_archive(frame * 2)] == [b"abc", b"abc"]
    content = zstandard.ZstdCompressor().compress(b"WARC/1.1 dictionary of some bytes")
    own = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(b"WARC/1.1 dictionary of some bytes")).compress(ok)
    assert len(list(W.read_archive(W.skippable(content) + own))) == 1
    for bad in (ok.replace(b"abc", b"abd"), ok.replace(b"Length: 3", b"Length: 4"), ok[:-1], b"HTTP/1.1" + ok[8:], ok.replace(b"WARC-Type: ", b"WARC-Type ")):
        with pytest.raises((ValueError, KeyError)):
            list(W.read_archive(zstandard.ZstdCompressor().compress(bad)))
    for data in (frame[:-3], frame + b"junk", W.skippable(b"x" * 50)[:20]):
        with pytest.raises(Exception):
            list(W.read_archive(data))


# ---------------------------------------------------------------- pipeline


def test_pipeline_keeps_what_it_should(spark, sf_dir, tmp_path):
    import corpus_pipeline

    r = random.Random(9)
    text = lambda: " ".join(f"w{r.randrange(5000)}" for _ in range(120))
    base = {i: text() for i in range(40)}
    near = {i: base[i - 100] + " more" for i in range(100, 105)}
    rows = [(i, t, "en", f"s{i % 2}", len(t)) for i, t in ({**base, **near, 200: base[7], 300: "short", 301: "a b c " * 40}).items()] + [(None, text(), None, None, None), (302, None, "en", "s0", 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, sf_dir)
        d.write.parquet(f"{tmp_path}/{len(kept)}")
        d = spark.read.parquet(f"{tmp_path}/{len(kept)}")
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept.append({x.doc_id for x in d.select("doc_id").collect()})
    clean = set(base) | set(near) | {200}
    assert kept[0] - {None} == clean and kept[1] - {None} == clean - {7} and kept[2] - {None} == clean - set(near) - {7}
    assert kept[3] <= kept[2] and len(kept[3]) > 10
    out = corpus_pipeline.STAGES[-1][1](spark, d, sf_dir)
    assert {x.doc_id for x in out.select("doc_id").collect()} == kept[3]


def test_pipeline_stages_judge_rows(spark, sf_dir):
    """Rejects and copies without an id go, of repeated rows one stays, and rows of one id go each by its own text."""
    import corpus_pipeline

    r = random.Random(10)
    t = [" ".join(f"w{r.randrange(5000)}" for _ in range(120)) for _ in range(7)]
    d = lambda rows: spark.createDataFrame([(i, x, "en", "s", 0) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)

    def kept(stage, rows):
        out = getattr(corpus_pipeline, stage)(spark, d(rows), sf_dir)
        return sorted(((x.doc_id, x.text) for x in out.collect()), key=str)

    good = [(i, x) for i, x in enumerate(t)]
    assert kept("quality_rules", [*good, (None, "short"), (None, None), (0, "short"), (None, t[0]), (1, t[1])]) == sorted([*good, (None, t[0]), (1, t[1])], key=str)
    got = kept("exact_dedup", [*good, (None, t[0]), (1, t[1]), (1, t[1]), (1, t[2]), (None, "x"), (None, "x"), (8, None), (8, "")])
    assert [x for x in got if x[0] != 8] == sorted([*good, (None, "x")], key=str) and len(got) == len(good) + 2
    near = lambda x: x + " more"
    got = kept("ngram_join", [*good[:5], (None, near(t[0])), (9, near(t[1])), (9, t[5]), (2, t[2]), (None, t[6]), (None, near(t[6])), (None, " ")])
    assert [x for x in got if x[0] is not None] == sorted([*good[:5], (9, t[5])], key=str)
    assert sorted(x[1] == " " for x in got if x[0] is None) == [False, True]


def test_pipeline_takes_empty_tables_and_clashing_columns(spark, sf_dir):
    import corpus_pipeline

    r = random.Random(14)
    names = ["_key", "key", "k", "kept", "copies", "size", "_size", "_u", "_b", "_p", "_bits", "_bucket", "component_id", "share", "w", "mean", "host", "row", "piece", "best"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    t = [" ".join(f"w{r.randrange(5000)}" for _ in range(120)) for _ in range(12)]
    rows = [(i, x, "en", f"s{i % 2}", 9, *(f"{n}{i}" for n in names)) for i, x in enumerate(t)]
    rows += [(20, t[3], "en", "s0", 9, *names), (21, t[4] + " more", "en", "s0", 9, *names), (22, "short", "en", "s0", 9, *names), rows[5], rows[5]]
    d, empty = spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)
    want = [{*range(12), 20, 21}, {*range(12), 20, 21} - {3}, {*range(12), 20} - {3}]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        d, empty = stage(spark, d, sf_dir), stage(spark, empty, sf_dir)
        assert d.columns == empty.columns == [c.split()[0] for c in schema.split(", ")] and empty.count() == 0
        got = d.collect()
        assert all(x._key in ("_key", f"_key{x.doc_id}") and x._b in ("_b", f"_b{x.doc_id}") and x.copies in ("copies", f"copies{x.doc_id}") for x in got)
        if k < 3:
            assert {x.doc_id for x in got} == want[k] and (k == 0 or len(got) == len(want[k]))
    assert corpus_pipeline.STAGES[-1][1](spark, empty, sf_dir).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, d, sf_dir).select("doc_id").distinct().count() == d.select("doc_id").distinct().count()


def test_repeated_rows_and_null_ids_in_mixing_packing_and_archives(spark, tokenizer):
    rows = [(1, "a b c", "s", "x")] * 3 + [(None, "a b c", "s", "x"), (None, None, None, "x"), (2, "d " * 3_000, None, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, copies string")
    mixed = mix_sources(d).collect()
    assert len(mixed) == 6 and len({x.taken for x in mixed if x.doc_id == 1}) == 1 and all(0 <= x.taken <= 3 * x["size"] for x in mixed)
    pieces = P.pack_documents(d, tokenizer).collect()
    assert sum(x.doc_id == 1 for x in pieces) == 3 and sum(x.doc_id is None for x in pieces) == 2
    places = sorted((x.sequence_id, x.offset, x.length) for x in pieces)
    assert all(a[0] != b[0] or a[1] + a[2] == b[1] for a, b in zip(places, places[1:])) and all(x[1] == 0 for x in {p[0]: p for p in reversed(places)}.values())
    pages = spark.createDataFrame([(1, "u", "p")] * 2 + [(0, "u", "p"), (None, "u", "p"), (None, None, None), (5, "u", "")], "page_id long, url string, html string")
    out = sorted((x.page_id if x.page_id is not None else -1, x.record_type, x.refers_to) for x in W.archive_pages(pages).collect())
    assert out == [(-1, "revisit", 1), (-1, "revisit", 5), (0, "revisit", 1), (1, "response", None), (1, "response", None), (5, "response", None)]


def test_without_rows_is_an_anti_join(spark, monkeypatch):
    from latticework.llm import common as C

    r = random.Random(11)
    d = spark.createDataFrame([(None if i % 50 == 0 else r.randrange(-(2**40), 2**40) if i % 2 else i, f"t{i}") for i in range(2000)], "doc_id long, text string")
    ids = [x.doc_id for x in d.collect() if x.doc_id is not None]
    gone = r.sample(ids, 700) + [-1, 10**15]
    for bits in (C.FILTER_BITS, 1 << 15, 1 << 16):
        monkeypatch.setattr(C, "FILTER_BITS", bits)
        out = C.without_rows(d, spark.createDataFrame([(x,) for x in gone], "doc_id long"))
        want = sorted(x.text for x in d.collect() if x.doc_id is None or x.doc_id not in set(gone))
        assert sorted(x.text for x in out.collect()) == want and out.columns == d.columns
    hits = C.without_rows(d, spark.createDataFrame([], "doc_id long"))
    assert hits.count() == 2000
