"""N-gram Jaccard join with several global token orders.

A document's set holds its distinct k-word shingles. Two documents link when
``100 * |A & B| >= percent * |A | B|``. Every global order of the shingles gives
a prefix filter: of n shingles, the first ``n - ceil(t n) + 1`` must hold one that
the partner has among its own first ones. A pair is verified only if it passes
this filter under every one of three orders.

All three orders begin with the rarest shingles, and differ in how they break
near-ties: (document frequency, hash), (its binary logarithm, a second hash),
(its binary logarithm, a third hash). So shingles of one document only, which no
partner can hold, come first; where they fill a prefix, the document is done.

How frequencies are found without a row per shingle: a task packs the sets of
about a million words (a *chunk*) into blocks, one for each range of shingle
hashes. A block goes to the task of its range, which counts, and sends back the
shared shingles only; those regroup by chunk. A range is counted in parts, one after the other,
so that a task holds a part's entries at a time. A shingle which several documents
of a chunk hold is sent once with its count, so that a hot shingle costs its
range one entry per chunk, not one per document.

Equal sets count once (a 128-bit digest and the size decide); the members take their
representative's component. Links are followed hub by hub: in the list of a prefix shingle the
member with most links is compared with all members of other components. Where that no longer
helps, every pair of members in different components is looked at, in blocks of bounded size,
by signatures that bound the overlap from above; pairs that pass are verified. So no component
is missed, and the components of a group of near copies cost little more than its size.

All links are inside components. Where they are asked for, every two sets of a component meet in one
task, by pairs of blocks of bounded size, and their overlaps are counted exactly from lists by
shingle. That is quadratic in a component's sets, as the number of its links may be.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm import common as C
from latticework.llm.components import connected_components

_U = np.uint64
_TOK = _U((1 << 48) - 1)
CHUNK_BYTES = 2_000_000
CHUNK_DOCS = 40_000
#: Rows of a block of a long list, and of one whose blocks would otherwise be few large tasks.
BLOCK = 4_096
SMALL_BLOCK = 512
#: Every task's range of shingles is counted in so many parts, one after the other.
RANGES = 16
BLOCK_TOKENS = 1_000_000
PAIRS_AT_ONCE = 500_000
SIGNATURE_BITS = 1_024
_BLOCKS = "kind int, part int, sub int, chunk long, docs binary, toks binary"
_BLOCK_TYPES = {"kind": pa.int32(), "part": pa.int32(), "sub": pa.int32(), "chunk": pa.int64(), "docs": pa.binary(), "toks": pa.binary()}
_SETS = "row long, doc_id long, n long, d1 long, d2 long, toks array<long>, p1 array<long>, p2 array<long>, p3 array<long>, sig binary"


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Text index and 48-bit hash of every distinct shingle, sorted by both."""
    buf, off = C.text_buffer(texts)
    starts, ends, doc = C.words(buf, off)
    h = C.word_hashes(buf, starts, ends, lower=True)
    per = np.bincount(doc, minlength=len(texts))
    at = np.concatenate(([0], np.cumsum(per)))[:-1]
    w = C.window_hashes(h, k)
    ok = doc[: len(w)] == doc[k - 1 :] if len(w) else np.zeros(0, bool)
    keys = [(doc[: len(w)][ok].astype(_U) << _U(48)) | (w[ok] >> _U(16))]
    short = np.flatnonzero((per > 0) & (per < k))
    if len(short):
        s = np.zeros(len(short), _U)
        for j in range(k - 1):
            has = per[short] > j
            s[has] += C.mix64(h[at[short[has]] + j] + _U((0xE7037ED1A0B428DB * (j + 1)) & (2**64 - 1)))
        keys.append((short.astype(_U) << _U(48)) | (C.mix64(s + per[short].astype(_U)) >> _U(16)))
    key = np.sort(np.concatenate(keys))
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    return (key >> _U(48)).astype(np.int64), key & _TOK


def _pack(tok: np.ndarray) -> bytes:
    return (tok & _U(0xFFFFFFFF)).astype("<u4").tobytes() + (tok >> _U(32)).astype("<u2").tobytes()


def _unpack(b: bytes) -> np.ndarray:
    n = len(b) // 6
    return np.frombuffer(b, "<u4", n).astype(_U) | (np.frombuffer(b, "<u2", n, 4 * n).astype(_U) << _U(32))


def _blocks(parts: int, k: int):
    """Chunks to rows of kind 0 (entries to count), 1 (members of locally shared shingles), 2 (header)."""

    def chunk_rows(part: pa.RecordBatch, first: int):
        ids = part.column(0).to_pylist()
        doc, tok = shingle_sets(part.column(1), k)
        n = np.bincount(doc, minlength=len(ids)).astype("<i8")
        edge = np.concatenate(([0], np.cumsum(n)))
        sums = []
        for salt in (0x51_7C_C1_B7_27_22_0A_95, 0x2545F4914F6CDD1D):
            c = np.concatenate((np.zeros(1, _U), np.cumsum(C.mix64(tok + _U(salt)))))
            sums.append(c[edge[1:]] - c[edge[:-1]])
        head = pa.BufferOutputStream()
        table = pa.table({"row": first + np.arange(len(ids)), "doc_id": pa.array(ids, pa.int64()), "n": n, "d1": sums[0].astype(np.int64), "d2": sums[1].astype(np.int64)})
        with pa.ipc.new_stream(head, table.schema) as out:
            out.write_table(table)
        head = head.getvalue().to_pybytes()
        chunk = int(np.frombuffer(hashlib.blake2b(head, digest_size=8).digest(), "<i8")[0])
        away = chunk % parts
        yield 2, away, -1, chunk, b"", head
        uniq, inverse, count = np.unique(tok, return_inverse=True, return_counts=True)
        alone = count[inverse] == 1
        if not alone.all():
            yield 1, away, -1, chunk, doc[~alone].astype("<u2").tobytes(), _pack(tok[~alone])
        # entries: for a shingle of one document its index, else 65535 and the count as a second entry list
        order = np.argsort(inverse[alone], kind="stable")
        who = np.full(len(uniq), 65535, "<u2")
        who[np.sort(inverse[alone])] = doc[alone][order]
        to = (uniq >> _U(24)) * _U(parts * RANGES) >> _U(24)
        cut = np.searchsorted(to, np.arange(parts * RANGES + 1, dtype=_U))
        for p in np.flatnonzero(np.diff(cut)).tolist():
            i, j = cut[p], cut[p + 1]
            shared = np.flatnonzero(who[i:j] == 65535)
            yield 0, p // RANGES, p % RANGES, chunk, who[i:j].tobytes() + count[i:j][shared].astype("<u2").tobytes(), _pack(uniq[i:j])

    def run(batches):
        # row numbers by partition and chunk, so that chunks with the same rows differ
        first = TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = []
            for part in C.slices(batch, "text", CHUNK_BYTES, CHUNK_DOCS):
                rows.extend(chunk_rows(part, first))
                first += part.num_rows
                if len(rows) > 5_000:
                    yield _rows(rows)
                    rows = []
            if rows:
                yield _rows(rows)

    return run


def _count(batches):
    """In the task of a range of shingles: the document frequency of the shared ones, back to their chunks.

    Rows come sorted by the parts of the range; what is held are the entries of one of them.
    """
    rows, entries, now = [], [], None
    for batch in batches:
        for kind, part, sub, chunk, docs, toks in zip(*(batch.column(i).to_pylist() for i in range(6))):
            if kind:
                rows.append((kind, part, sub, chunk, docs, toks))
                continue
            if sub != now:
                yield from _counted(entries)
                entries, now = [], sub
            entries.append((chunk, docs, toks))
        if rows:
            yield _rows(rows)
            rows = []
    yield from _counted(entries)


def _counted(entries):
    if not entries:
        return
    rows = []
    toks = [_unpack(t) for _, _, t in entries]
    sizes = np.array([len(t) for t in toks])
    every = np.concatenate(toks)
    count = np.ones(len(every), np.int64)
    at = np.concatenate(([0], np.cumsum(sizes)))
    who = []
    for (_, docs, _), i, m in zip(entries, at, sizes):
        w = np.frombuffer(docs, "<u2", m)
        who.append(w)
        count[i : i + m][w == 65535] = np.frombuffer(docs, "<u2", offset=2 * m)
    order = np.argsort(every)
    ranked = every[order]
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    total = np.add.reduceat(count[order], first)
    df = np.empty(len(every), np.int64)
    df[order] = np.repeat(total, np.diff(np.append(first, len(every))))
    for (chunk, _, _), t, w, i, m in zip(entries, toks, who, at, sizes):
        d = df[i : i + m]
        keep = d > 1
        if keep.any():
            rows.append((0, 0, 0, chunk, w[keep].tobytes() + np.minimum(d[keep], 2**32 - 1).astype("<u4").tobytes(), _pack(t[keep])))
        if len(rows) >= 500:
            yield _rows(rows)
            rows = []
    if rows:
        yield _rows(rows)


def _rows(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _BLOCK_TYPES.values())], list(_BLOCK_TYPES))


def _sets(percent: int):
    """A chunk's replies to a row per document; shared shingles and prefixes only where a partner is possible."""
    list_type = pa.list_(pa.int64())

    def built(table: pa.Table) -> pa.Table:
        head, doc, tok, df, wide = None, [], [], [], []
        for kind, docs, toks in zip(*(table.column(c).to_pylist() for c in ("kind", "docs", "toks"))):
            if kind == 2:
                head = pa.ipc.open_stream(toks).read_all()
                continue
            t = _unpack(toks)
            w = np.frombuffer(docs, "<u2", len(t)).astype(np.int64)
            if kind == 1:
                wide.append((w, t))
                continue
            doc.append(w)
            tok.append(t)
            df.append(np.frombuffer(docs, "<u4", len(t), 2 * len(t)).astype(np.int64))
        if head is None:
            raise RuntimeError("a chunk came without its header: its input changed between attempts")
        n = head.column("n").to_numpy()
        lists = {c: [None] * len(n) for c in ("toks", "p1", "p2", "p3")}
        sigs = [None] * len(n)
        if doc:
            doc, tok, df = np.concatenate(doc), np.concatenate(tok), np.concatenate(df)
            local = doc == 65535
            if wide:
                w, t = (np.concatenate(x) for x in zip(*wide))
                lt, ld = tok[local], df[local]
                o = np.argsort(lt)
                at = np.searchsorted(lt[o], t)
                doc, tok, df = np.concatenate((doc[~local], w)), np.concatenate((tok[~local], t)), np.concatenate((df[~local], ld[o][at]))
            have = np.bincount(doc, minlength=len(n))
            least = -(-n * percent // 100)
            alive = (have >= least) & (n > 0)
            keep = alive[doc]
            doc, tok, df = doc[keep], tok[keep], df[keep]
            log = np.floor(np.log2(np.maximum(df, 1))).astype(_U) << _U(48)
            orders = [np.lexsort((tok, df, doc))]
            for salt in (0x8CB92BA72F3D8DD7, 0xD1B54A32D192ED03):
                orders.append(np.lexsort((log | (C.mix64(tok ^ _U(salt)) >> _U(16)), doc)))
            edge = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(n)))))
            signed = tok.astype(np.int64)
            for i in np.flatnonzero(alive):
                a, b = edge[i], edge[i + 1]
                p = (n[i] - least[i] + 1) - (n[i] - have[i])
                lists["toks"][i] = signed[orders[0][a:b]]
                bits = np.zeros(SIGNATURE_BITS, bool)
                bits[(C.mix64(tok[orders[0][a:b]]) % _U(SIGNATURE_BITS)).astype(np.int64)] = True
                sigs[i] = np.packbits(bits).tobytes()
                for c, o in zip(("p1", "p2", "p3"), orders):
                    lists[c][i] = signed[o[a : a + p]]
        return pa.table({**{c: head.column(c) for c in ("row", "doc_id", "n", "d1", "d2")}, **{c: pa.array(v, list_type) for c, v in lists.items()}, "sig": pa.array(sigs, pa.binary())})

    def run(table: pa.Table) -> pa.Table:
        out = built(table)
        C.release()
        return out

    return run


def document_sets(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """A row per document: a number of its own, size and digest of its set; shared shingles and the prefixes under three
    orders where so many are shared that a partner is possible, else null. Staged."""
    spark = docs.sparkSession
    parts = min(60_000, C.shuffle_partitions(spark))
    rows = C.stable(C.need(docs, "doc_id", "text")).mapInArrow(C.tidy(_blocks(parts, k)), _BLOCKS)
    counted = rows.repartitionById(parts, "part").sortWithinPartitions("sub").mapInArrow(C.tidy(_count), _BLOCKS)
    return C.stage(counted.groupBy("chunk").applyInArrow(_sets(percent), _SETS), "ngram-sets")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among candidate pairs (a, b): the other orders' filters first, then the exact overlap."""
    a = sets.select(F.col("id").alias("a"), F.col("n").alias("an"), F.col("toks").alias("at"), F.col("p2").alias("a2"), F.col("p3").alias("a3"))
    b = sets.select(F.col("id").alias("b"), F.col("n").alias("bn"), F.col("toks").alias("bt"), F.col("p2").alias("b2"), F.col("p3").alias("b3"))
    both = pairs.join(a, "a").join(b, "b").where(F.arrays_overlap("a2", "b2") & F.arrays_overlap("a3", "b3"))
    common = F.size(F.array_intersect("at", "bt"))
    return both.where(100 * common >= percent * (F.col("an") + F.col("bn") - common)).select("a", "b")


def _scan(percent: int):
    """Pairs of members of one list (or of two blocks of it) that may link, of different components.

    Rows come sorted by list. A shingle whose bit the other signature lacks is not in the other
    set; what is left bounds the overlap from above. A list goes on in the next batch at most
    until its blocks end, so what is held is bounded.
    """
    names = ["tok", "i", "j", "block", "id", "n", "have", "component"]

    def pairs(t: pa.Table):
        tok, i, j, block, ids, n, have, comp = (t.column(c).to_numpy() for c in names)
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u8").reshape(len(ids), -1)
        new = np.ones(len(ids), bool)
        new[1:] = (tok[1:] != tok[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        ends = np.append(np.flatnonzero(new)[1:], len(ids))
        after = ends[np.cumsum(new) - 1] - np.arange(len(ids)) - 1
        upto = np.cumsum(after)
        at = 0
        while at < len(ids):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
            count = after[at:stop]
            x = np.repeat(np.arange(at, stop), count)
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(count) - count, count)
            ok = (comp[x] != comp[y]) & (ids[x] != ids[y]) & ((i[x] == j[x]) | (block[x] != block[y]))
            ok &= 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
            x, y = x[ok], y[ok]
            mine = have[x] - np.bitwise_count(sig[x] & ~sig[y]).sum(1, dtype=np.int64)
            its = have[y] - np.bitwise_count(sig[y] & ~sig[x]).sum(1, dtype=np.int64)
            most = np.minimum(mine, its)
            ok = 100 * most >= percent * (n[x] + n[y] - most)
            x, y = ids[x[ok]], ids[y[ok]]
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])
            at = stop

    def run(batches):
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([*held, batch])
            key = np.stack([t.column(c).to_numpy() for c in ("tok", "i", "j")])
            cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0))
            cut = cut[-1] + 1 if len(cut) else 0
            if cut:
                yield from pairs(t.slice(0, cut))
            held = t.slice(cut).to_batches()
        if held:
            yield from pairs(pa.Table.from_batches(held))

    return run


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """Component of every set that has links: (id, component)."""
    spark = sets.sparkSession
    lists = sets.select("id", "n", F.explode("p1").alias("tok"))
    several = lists.groupBy("tok").agg(F.count("*").alias("c")).where("c > 1").select("tok")
    lists = C.stage(lists.join(several, "tok", "left_semi"), "ngram-lists")
    fits = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    comp = spark.createDataFrame([], "id long, component long")
    links, state, before, last = None, None, None, False
    while not last:
        if state is None:
            members = lists.withColumns({"component": F.col("id"), "degree": F.lit(0).cast("long")})
        else:
            known = state.select(F.col("id").alias("member"), "component", "degree")
            members = lists.join(known, F.col("id") == F.col("member"), "left").withColumns({"component": F.coalesce("component", "id"), "degree": F.coalesce("degree", F.lit(0))}).drop("member")
        by = members.groupBy("tok", "component").agg(F.count("*").alias("c"), F.max(F.struct("degree", (-F.col("id")).alias("x"), "n", F.col("component").alias("hc"))).alias("hub"))
        by = by.groupBy("tok").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("cc"), F.count("*").alias("comps"), F.max("hub").alias("hub")).where("comps > 1")
        by = C.stage(by.select("tok", "hub", "c", ((F.col("c") * F.col("c") - F.col("cc")) / 2).alias("pairs")), "ngram-hubs")
        left = by.agg(F.sum("pairs"), F.sum("c")).first()
        if not left[0]:
            break
        last = left[0] <= 8 * left[1] or (before is not None and left[0] > before / 2)
        before = left[0]
        block = F.when(F.col("c") <= BLOCK * 4, SMALL_BLOCK).otherwise(BLOCK)
        again = members.join(by.select("tok", "hub", F.ceil(F.col("c") / block).alias("blocks")), "tok")
        if last:
            block = F.pmod(F.xxhash64("id"), F.col("blocks"))
            own = sets.select(F.col("id").alias("member"), F.size("toks").cast("long").alias("have"), "sig")
            again = again.join(own, F.col("id") == F.col("member")).withColumn("block", block).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
            again = again.select("tok", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "id", "n", "have", "component", "sig")
            again = again.repartition("tok", "i", "j").sortWithinPartitions("tok", "i", "j")
            pairs = again.mapInArrow(C.tidy(_scan(percent)), "a long, b long")
        else:
            hub = -F.col("hub.x")
            pairs = again.where((F.col("component") != F.col("hub.hc")) & fits(F.col("n"), F.col("hub.n"))).select(F.least("id", hub).alias("a"), F.greatest("id", hub).alias("b"))
        found = C.stage(_verified(pairs.distinct(), sets, percent), "ngram-links")
        C.unstage(by)
        if not found.isEmpty():
            links = found if links is None else links.union(found)
            comp = connected_components(links)
            if not last:
                degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
                C.unstage(state)
                state = C.stage(comp.join(degree, "id"), "ngram-state")
    C.unstage(lists, state)
    return comp


def _overlaps(percent: int, pairs: bool):
    """All links of the sets of a component (or of two blocks of it): (a, b), or for each set (id, n_links),
    the rows of the sets it links with. Rows come sorted by component and blocks."""

    def group(t: pa.Table):
        ids, n, size, block = (t.column(c).to_numpy() for c in ("id", "n", "size", "block"))
        toks = t.column("toks").combine_chunks()
        m, cross = len(ids), t.column("i")[0] != t.column("j")[0]
        off = toks.offsets.to_numpy().astype(np.int64)
        off = off - off[0]
        _, tok = np.unique(toks.flatten().to_numpy(), return_inverse=True)
        lists = np.argsort(tok, kind="stable")
        holder = np.repeat(np.arange(m, dtype=np.int32), np.diff(off))[lists]
        ends = np.cumsum(np.bincount(tok))
        starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
        found, linked = [], np.zeros(m, np.int64)
        for x in range(m):
            mine = tok[off[x] : off[x + 1]]
            starts[mine] += 1  # what is left of a list are the holders after x
            count = ends[mine] - starts[mine]
            at = np.arange(count.sum()) + np.repeat(starts[mine] - np.cumsum(count) + count, count)
            common = np.bincount(holder[at], minlength=m)
            ok = (common > 0) & (100 * common >= percent * (n[x] + n - common))
            y = np.flatnonzero(ok & (block != block[x]) if cross else ok)
            if len(y):
                linked[x] += size[y].sum()
                linked[y] += size[x]
                if pairs:
                    found.append((np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])))
        if pairs:
            return [np.concatenate(c) for c in zip(*found)] if found else None
        return (ids[linked > 0], linked[linked > 0]) if linked.any() else None

    def groups(t: pa.Table):
        key = np.stack([t.column(c).to_numpy() for c in ("component", "i", "j")])
        edge = np.concatenate(([0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1, [t.num_rows]))
        some = []
        for a, b in zip(edge[:-1], edge[1:]):
            out = group(t.slice(a, b - a)) if b - a > 1 else None
            if out is not None:
                some.append(out)
            if sum(len(c[0]) for c in some) > PAIRS_AT_ONCE or (b == t.num_rows and some):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*some)], ["a", "b"] if pairs else ["id", "n_links"])
                some = []

    def run(batches):
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = [[b.column(b.schema.get_field_index(c))[at].as_py() for c in ("component", "i", "j")] for b, at in ((held[-1], -1), (batch, 0), (batch, -1))] if held else None
            if key and key[0] == key[1] == key[2]:
                held.append(batch)
                continue
            t = pa.Table.from_batches([*held, batch])
            key = np.stack([t.column(c).to_numpy() for c in ("component", "i", "j")])
            cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0))
            cut = cut[-1] + 1 if len(cut) else 0
            if cut:
                yield from groups(t.slice(0, cut))
            held = t.slice(cut).to_batches()
        if held:
            yield from groups(pa.Table.from_batches(held))

    return run


def _all_links(sets: DataFrame, comp: DataFrame, percent: int, pairs: bool) -> DataFrame:
    """Every link of sets (id, n, size, toks) in components (id, component), as _overlaps gives them."""
    members = sets.join(comp, "id")
    bounds = members.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.size("toks")) / BLOCK_TOKENS)).alias("blocks"))
    rows = members.join(bounds, "component").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("component", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "id", "n", "size", "toks")
    rows = rows.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    return rows.mapInArrow(C.tidy(_overlaps(percent, pairs)), "a long, b long" if pairs else "id long, n_links long")


_SAME = ["d1", "d2", "n"]


def _joined(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows, groups of equal sets, one set of each group that may have partners, and components of those that have.

    A set's id is the number of one of its rows, so that sets without a doc_id take part, too.
    """
    sets = document_sets(docs, k, percent)
    groups = C.stage(sets.where("n > 0").groupBy(*_SAME).agg(F.min("row").alias("id"), F.min("doc_id").alias("least"), F.count("*").alias("size")), "ngram-groups")
    alive = sets.where(F.col("toks").isNotNull()).join(groups.select("id", "size"), F.col("row") == F.col("id"))
    alive = C.stage(alive.select("id", "size", "n", "toks", "p1", "p2", "p3", "sig"), "ngram-alive")
    return sets, groups, alive, _links(alive, percent)


def ngram_jaccard_links(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per two different sets that link: a, b (the smallest doc_id of each, null where only
    rows without one hold the set), a_rows, b_rows (how many rows hold them)."""
    _, groups, alive, comp = _joined(docs, k, percent)
    links = _all_links(alive.select("id", "n", "size", "toks"), comp, percent, pairs=True)
    for c in ("a", "b"):
        own = groups.select(F.col("id").alias(c), F.col("least").alias(f"{c}_least"), F.col("size").alias(f"{c}_rows"))
        links = links.join(own, c)
    return links.select(F.col("a_least").alias("a"), F.col("b_least").alias("b"), "a_rows", "b_rows")


def ngram_jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, links: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links).

    With ``links`` also n_links: the other rows that a row links with, those of equal sets included.

    Null, empty and wordless texts have an empty set (0) and are their own component. With
    fewer than k words the whole sequence is the one shingle. A null doc_id reaches its
    component but never names it; alone, its component is null. Repeated rows give repeated
    rows; rows of one doc_id that differ in text go each by its own text. Other columns are
    ignored.
    """
    sets, groups, alive, comp = _joined(docs, k, percent)
    named = C.stage(comp.join(groups.select("id", "least"), "id"), "ngram-components")
    named = named.join(named.groupBy("component").agg(F.min("least").alias("name")), "component").select("id", "name")
    counts = []
    groups = groups.join(named, "id", "left").withColumn("component", F.coalesce("name", "least"))
    if links:
        found = _all_links(alive.select("id", "n", "size", "toks"), comp, percent, pairs=False).groupBy("id").agg(F.sum("n_links").alias("n_links"))
        groups = groups.join(found, "id", "left").withColumn("links", F.coalesce("n_links", F.lit(0)) + F.col("size") - 1)
        counts = [F.coalesce("links", F.lit(0)).alias("n_links")]
    out = sets.select("doc_id", *_SAME).join(groups.drop("id", "least", "size", "name", "n_links"), _SAME, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), *counts)
