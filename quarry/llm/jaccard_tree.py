"""N-gram Jaccard join with signature trees: exact links between texts, and their components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import components, cut, own_names, partitions
from quarry.llm.shingles import mixed, shingles, words_of

K = 5                  # words in a shingle
PERCENT = 80           # two sets link at this intersection to union, or above
BLOCK = 256            # documents of a bucket that meet in one task, on each side
FAMILY = 2048          # documents of a family that meet in one task, on each side
FANOUT = 8             # children of a tree node
CELLS = 1 << 20        # counters of the sketch that orders shingles by how common they are
CHUNK = 1 << 16        # counters that travel in one row
SMALL = 2_000_000      # texts named by numbers up to so many (16 MB) are picked by a broadcast list, beyond by a join


def _cell(own: np.ndarray) -> np.ndarray:
    return (own >> np.uint64(40)).astype(np.int64) & (CELLS - 1)


def _sketcher(k: int):
    def run(batches):
        total = np.zeros(CELLS, np.int64)
        for batch in batches:
            for _, offsets, words in words_of(batch.column(0)):
                own = [_cell(np.unique(shingles(words[a:b], k))) for a, b in zip(offsets[:-1], offsets[1:])]
                total += np.bincount(np.concatenate(own), minlength=CELLS)
        some = [c for c in range(CELLS // CHUNK) if total[c * CHUNK:(c + 1) * CHUNK].any()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array([total[c * CHUNK:(c + 1) * CHUNK].astype(np.int32).tobytes() for c in some], pa.binary())],
            ["chunk", "counts"])
    return run


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.int32).astype(np.int64) for x in table.column("counts").to_pylist())
    return pa.table({"chunk": table.column("chunk")[:1], "counts": pa.array([np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()], pa.binary())})


def commonness(docs: DataFrame, k: int) -> np.ndarray:
    """For each counter, how far its count of documents stands out: 0 within chance, then the excess in powers of two.

    A sketch of fixed size, counted over all shingles of all documents.  It only orders the shingles, rare ones
    first; any order that is the same for all documents gives the same links.
    """
    got = (docs.select("text").mapInArrow(_sketcher(k), "chunk int, counts binary").groupBy("chunk")
           .applyInArrow(_added, "chunk int, counts binary").collect())              # CELLS counters in all
    total = np.zeros(CELLS)
    for r in got:
        total[r.chunk * CHUNK:(r.chunk + 1) * CHUNK] = np.frombuffer(r.counts, np.int32)
    middle = float(np.median(total))
    excess = total - middle - 6 * np.sqrt(middle + 1)
    return np.where(excess > 0, 1 + np.floor(np.log2(np.maximum(excess, 1))), 0).astype(np.int8)


def _signer(k: int, percent: int, common: np.ndarray):
    def run(batches):
        for batch in batches:
            n, s, keys, bits = [], [], [], []
            for _, offsets, words in words_of(batch.column(2)):
                for a, b in zip(offsets[:-1], offsets[1:]):
                    own = np.unique(shingles(words[a:b], k))
                    size = len(own)
                    n.append(size)
                    s.append(int(mixed(own + np.uint64(7)).sum().view(np.int64)) if size else 0)
                    need = -(-percent * size // 100)
                    rare = own[np.argsort(common[_cell(own)], kind="stable")[: size - need + 1]] if size else own
                    keys.append(rare.view(np.int64))
                    bits.append(bitmap(own))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(s, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()),
                                          pa.array(np.concatenate([np.zeros(0, np.int64), *keys]))),
                 pa.array(bits, pa.binary())], ["doc_id", "th", "n", "s", "keys", "bits"])
    return run


def width(n: int) -> int:
    """Bits of a set's signature: two to four for each member, a power of two."""
    return max(64, 1 << int(2 * n - 1).bit_length()) if n else 64


def bitmap(own: np.ndarray) -> bytes:
    """The set's signature; halves OR to the signature of half the width."""
    w = width(len(own))
    flat = np.zeros(w, np.uint8)
    flat[(mixed(own) & np.uint64(w - 1)).astype(np.int64)] = 1
    return np.packbits(flat, bitorder="little").tobytes()


def _folded(maps: np.ndarray, words: int) -> np.ndarray:
    while maps.shape[1] > words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] | maps[:, half:]
    return maps


class Tree:
    """Signature tree over documents of one width: a node has the OR of its signatures, the range of its set sizes, the
    largest number of members that share a bit with others (``loose``), and its component if all documents have one."""

    def __init__(self, maps: np.ndarray, n: np.ndarray, comp: np.ndarray, loose: np.ndarray):
        self.levels = [(maps, n, n, loose, comp, np.ones(len(n), bool))]
        while len(self.levels[-1][0]) > 1:
            m, lo, hi, ls, c, one = self.levels[-1]
            at = np.arange(0, len(m), FANOUT)
            same = (np.minimum.reduceat(c, at) == np.maximum.reduceat(c, at)) & np.logical_and.reduceat(one, at)
            self.levels.append((np.bitwise_or.reduceat(m, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at),
                                np.maximum.reduceat(ls, at), c[at], same))

    def children(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each node in turn: its place in ``nodes`` and the child."""
        count = np.minimum(FANOUT, len(self.levels[level - 1][0]) - nodes * FANOUT)
        who = np.repeat(np.arange(len(nodes)), count)
        first = np.repeat(np.cumsum(count) - count, count)
        return who, np.repeat(nodes * FANOUT, count) + np.arange(len(who)) - first


def traverse(left: Tree, right: Tree, percent: int = PERCENT, slab: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of documents, one of each tree, that may link and are in different components.

    Node pairs go down level by level.  A pair of nodes is dropped if its sizes
    can't fit, if all below is one component, or if the largest possible
    overlap, the common bits of both OR-maps plus the members that share bits,
    is less than the smallest sets need.
    """
    la, lb = len(left.levels) - 1, len(right.levels) - 1
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        ma, loa, hia, lsa, ca, oa = left.levels[la]
        mb, lob, hib, lsb, cb, ob = right.levels[lb]
        ok = ((100 * hia[a] >= percent * lob[b]) & (100 * hib[b] >= percent * loa[a]) & ~(oa[a] & ob[b] & (ca[a] == cb[b])))
        a, b = a[ok], b[ok]
        step = max(1, slab // max(1, ma.shape[1]))
        most = np.concatenate([np.zeros(0, np.int64)] + [
            np.bitwise_count(ma[a[i:i + step]] & mb[b[i:i + step]]).sum(1, dtype=np.int64) for i in range(0, len(a), step)])
        most += np.minimum(lsa[a], lsb[b])
        ok = (100 + percent) * most >= percent * (loa[a] + lob[b])
        a, b = a[ok], b[ok]
        if la == 0 and lb == 0 or not len(a):
            return a, b
        if la >= lb:
            who, a = left.children(la, a)
            b, la = b[who], la - 1
        else:
            who, b = right.children(lb, b)
            a, lb = a[who], lb - 1


def may_link(s: np.ndarray, n: np.ndarray, comp: np.ndarray, side: np.ndarray, bits: list[bytes], percent: int):
    """Pairs ``(i, j)`` of a task's documents that the trees leave over: left (side 0 or 2) with right (1 or 2)."""
    widths = np.array([8 * len(x) for x in bits])
    trees = {}
    for w in np.unique(widths):
        for d in (0, 1):
            which = np.flatnonzero((widths == w) & ((side == d) | (side == 2)))
            if len(which):
                which = which[np.lexsort((s[which], n[which], comp[which]))]
                maps = np.frombuffer(b"".join(bits[i] for i in which), np.uint64).reshape(len(which), -1)
                trees[int(w), d] = which, maps
    found = []
    for (w, d), (left, maps) in trees.items():
        for v in (w // 2, w, 2 * w):                       # sizes that fit differ by less than a width
            if d == 0 and (v, 1) in trees:
                right, others = trees[v, 1]
                words = min(maps.shape[1], others.shape[1])
                x, y = _folded(maps, words), _folded(others, words)
                grown = [Tree(m, n[i], comp[i], n[i] - np.bitwise_count(m).sum(1, dtype=np.int64)) for m, i in ((x, left), (y, right))]
                a, b = traverse(*grown, percent)
                found.append((left[a], right[b]))
    i, j = (np.concatenate([np.zeros(0, np.int64), *[f[k] for f in found]]) for k in (0, 1))
    return i, j


class Union:
    """Disjoint sets over 0 to n - 1."""

    def __init__(self, n: int):
        self.top = list(range(n))

    def find(self, x: int) -> int:
        while self.top[x] != x:
            self.top[x] = self.top[self.top[x]]
            x = self.top[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.top[max(x, y)] = min(x, y)
        return x != y


def _labelled(comp: np.ndarray) -> Union:
    union = Union(len(comp))
    first: dict = {}
    for i, c in enumerate(comp.tolist()):
        union.join(i, first.setdefault(c, i))
    return union


def _by_task(handle, columns: list[str]):
    """Runs ``handle(table)`` on each task's rows (equal ``key, i, j``) of a partition sorted by task; yields its pairs ``a, b``."""
    def run(batches):
        held: list[pa.RecordBatch] = []

        def task_of(table):
            return np.stack([table.column(c).to_numpy() for c in ("key", "i", "j")])

        def flush(table: pa.Table):
            task = task_of(table)
            edge = np.flatnonzero(np.concatenate([[True], (task[:, 1:] != task[:, :-1]).any(0)]))
            pairs = [handle(table.slice(a, b - a)) for a, b in zip(edge.tolist(), [*edge[1:].tolist(), table.num_rows])]
            x, y = np.concatenate([np.zeros((2, 0), np.int64), *pairs], axis=1)
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

        for batch in batches:                              # the last task may go on in the next batch
            if not batch.num_rows:
                continue
            held.append(batch)
            table = pa.Table.from_batches(held).select(columns)
            task = task_of(table)
            last = np.flatnonzero((task != task[:, -1:]).any(0))
            if len(last):
                upto = int(last[-1]) + 1
                yield flush(table.slice(0, upto))
                held = table.slice(upto).combine_chunks().to_batches()
        if held:
            yield flush(pa.Table.from_batches(held).select(columns))
    return run


def _spanning(percent: int):
    """Of a task's pairs that may link, those that join something: fewer than its documents."""
    def handle(table: pa.Table) -> np.ndarray:
        s, n, comp, side = (table.column(c).to_numpy() for c in ("s", "n", "comp", "side"))
        i, j = may_link(s, n, comp, side, table.column("bits").to_pylist(), percent)
        union = _labelled(comp)
        keep = [k for k, (x, y) in enumerate(zip(i.tolist(), j.tolist())) if union.join(x, y)]
        return np.stack([s[i[keep]], s[j[keep]]])
    return handle


def _linking(k: int, percent: int):
    """The links of a task's documents, counted out on their texts, that join something: fewer than its documents.

    Signature trees leave the pairs that may link; the document with the most of them goes first and is counted against all
    its partners that it is not yet joined with.
    """
    def handle(table: pa.Table) -> np.ndarray:
        s, comp, side = (table.column(c).to_numpy() for c in ("s", "comp", "side"))
        own = [np.unique(shingles(w[a:b], k)) for _, off, w in words_of(table.column("text")) for a, b in zip(off[:-1], off[1:])]
        n = np.array([len(x) for x in own])
        i, j = may_link(s, n, comp, side, [bitmap(x) for x in own], percent)
        ends = np.cumsum(n)
        _, flat = np.unique(np.concatenate(own), return_inverse=True)
        mark = np.zeros(int(flat.max(initial=-1)) + 1, bool)
        union = _labelled(comp)
        x, y = np.concatenate([i, j]), np.concatenate([j, i])
        order = np.argsort(x, kind="stable")
        x, y = x[order], y[order]
        first = np.searchsorted(x, np.arange(len(s) + 1))
        found = []
        for v in np.argsort(-np.diff(first), kind="stable").tolist():
            partners = y[first[v]:first[v + 1]]
            partners = partners[[union.find(p) != union.find(v) for p in partners.tolist()]] if len(partners) else partners
            if not len(partners):
                continue
            mark[flat[ends[v] - n[v]:ends[v]]] = True
            size = n[partners]
            stop = np.cumsum(size)
            at = np.repeat(ends[partners] - size - (stop - size), size) + np.arange(int(stop[-1]))
            both = np.add.reduceat(mark[flat[at]].astype(np.int64), stop - size)
            mark[flat[ends[v] - n[v]:ends[v]]] = False
            for p in partners[100 * both >= percent * (n[v] + size - both)].tolist():
                if union.join(v, p):
                    found.append((s[v], s[p]))
        return np.array(found, np.int64).reshape(-1, 2).T
    return handle


def _cross_tasks(members: DataFrame, block_size: int) -> DataFrame:
    """``key, i, j, side, s, comp`` of ``members(key, s, comp)``: every two documents of a key in different components meet in a task.

    A key within one component is done.  In the others the documents of the
    largest component need not meet each other, only the rest; both are dealt into
    blocks of about ``block_size``, and every task gets two blocks.
    """
    sizes = members.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    open_ = (sizes.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("all"), F.min("comp").alias("x"),
                                      F.max("comp").alias("y")).where("x <> y")
             .select("key", F.col("top.comp").alias("top"), F.ceil(F.col("top.c") / block_size).cast("int").alias("many"),
                     F.ceil((F.col("all") - F.col("top.c")) / block_size).cast("int").alias("few")))
    dealt = members.join(open_, "key").withColumn("big", F.col("comp") == F.col("top"))
    block = F.when(F.col("big"), F.pmod(F.xxhash64("s"), F.col("many"))).otherwise(F.pmod(F.xxhash64("s"), F.col("few"))).cast("int")
    dealt = dealt.withColumn("block", block)
    task = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))
    own = F.col("block")
    big = F.transform(F.sequence(F.lit(0), F.col("few") - 1), lambda j: task(-1 - own, j, 0))
    small = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("many") - 1), lambda i: task(-1 - i, own, 1)),
        F.transform(F.sequence(F.lit(0), F.col("few") - 1), lambda j: F.when(j == own, task(own, own, 2)).when(
            j > own, task(own, j, 0)).otherwise(task(j, own, 1))))
    tasks = dealt.select("key", "s", "comp", F.explode(F.when(F.col("big"), big).otherwise(small)).alias("t"))
    return tasks.select("key", "t.i", "t.j", "t.side", "s", "comp")


def _met(rows: DataFrame, handle, columns: list[str]) -> DataFrame:
    n = partitions(rows.sparkSession)
    dealt = rows.select(*columns).repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(_by_task(handle, columns), "a long, b long")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``th, text`` of the texts named in ``wanted(th)``, each once."""
    wanted = cut(wanted.select("th").distinct())
    if wanted.count() <= SMALL:                            # 8 bytes each
        wanted = F.broadcast(wanted)
    return docs.select(F.xxhash64("text").alias("th"), "text").join(wanted, "th", "left_semi").dropDuplicates(["th"])


def _named(nodes: DataFrame, links: DataFrame) -> DataFrame:
    return components(nodes.select(F.col("s").alias("node")), links).select(F.col("node").alias("s"), F.col("component").alias("comp"))


def link_components(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """``doc_id, th, n_shingles, component_id`` for all ``docs`` (``doc_id, text``); ``th`` is the text's ``xxhash64``.

    Sets are the distinct ``k``-word shingles of whole texts (fewer words: the
    whole as one; none: empty, linked with nothing).  Two sets link when their
    Jaccard similarity is ``percent`` hundredths or more; a document's component
    is named by the smallest ``doc_id`` reachable over links.

    1. One Arrow pass gives each document its set's size, a 64-bit name of the set
       (equal sets are one from here on), its ``n - need + 1`` rarest shingles (by a sketch
       of all documents' shingles, then by hash) and a signature of two to four bits a shingle.  Linked sets share one of
       those shingles at least, so its bucket holds both.  Hashes that
       one set alone has drop out in a pre-aggregated count; of buckets with the
       same members one stays.
    2. Each set is held against the first of the bucket it has most often, and
       buckets whose sets are not yet in one family are joined by signature trees: nodes
       hold the OR of the signatures below and the range of their sizes, and a dual
       traversal drops node pairs by their largest possible overlap.  A pair that
       is left joins two families.  Sets in different families can't link.
    3. The texts of each family of two or more meet once, and signature trees again leave the pairs to be counted out.

    No link is lost, while copies are never expanded into all pairs: a task returns fewer pairs than it has documents.
    Large buckets and families are dealt to many tasks of two blocks each; of a large family the
    blocks are joined alone first, and then only documents outside its largest component meet the other blocks.

    A null or empty text has an empty set.  Null ids stay rows of their own
    (``component_id`` is the smallest id that is not null, null if there is none, or if it stands alone).
    Rows that repeat are one set.  An empty table gives no rows; other columns do not matter.
    """
    docs = docs.select("doc_id", "text")
    sig = cut(docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(
        _signer(k, percent, commonness(docs, k)), "doc_id long, th long, n long, s long, keys array<long>, bits binary"))
    each = sig.select("s", F.explode("keys").alias("key"))
    shared = each.groupBy("key").agg(F.min("s").alias("x"), F.max("s").alias("y")).where("x <> y").select("key")
    held = cut(each.join(shared, "key").distinct())
    buckets = cut(held.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("s").alias("lead"), F.sum(
        F.xxhash64("s").cast("decimal(20,0)")).alias("name")))
    chosen = buckets.groupBy("c", "lead", "name").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("weight"))
    members = cut(held.join(chosen.select("key", "lead", "weight"), "key"))
    wanted = members.select("s").distinct()
    nodes = cut(sig.join(wanted, "s", "left_semi").groupBy("s").agg(
        F.first("n").alias("n"), F.min("th").alias("th"), F.first("bits").alias("bits")))

    first = (members.where("s <> lead").groupBy("s", "lead").agg(F.sum("weight").alias("w"))
             .groupBy("s").agg(F.max_by("lead", F.struct("w", "lead")).alias("lead")))
    sides = (first.join(nodes.select("s", "n", F.col("bits").alias("bs")), "s")
             .join(nodes.select(F.col("s").alias("lead"), F.col("n").alias("m"), F.col("bits").alias("bl")), "lead"))
    near = cut(sides.mapInArrow(_bounder(percent), "a long, b long"))
    labels = cut(_named(nodes, near))
    tasks = _cross_tasks(members.select("key", "s").join(labels, "s"), BLOCK).join(nodes.select("s", "n", "bits"), "s")
    more = cut(_met(tasks, _spanning(percent), ["key", "i", "j", "side", "s", "n", "comp", "bits"]))
    families = _named(nodes, near.unionByName(more)).withColumnRenamed("comp", "key")
    sizes = families.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    families = cut(families.join(sizes, "key").join(nodes.select("s", "th"), "s").select("key", "s", "th", "size"))

    columns = ["key", "i", "j", "side", "s", "comp", "text"]
    block = F.pmod(F.xxhash64("s"), F.ceil(F.col("size") / FAMILY)).cast("int")
    alone = families.join(_texts(docs, families), "th").select(
        "key", block.alias("i"), block.alias("j"), F.lit(2).alias("side"), "s", F.col("s").alias("comp"), "text")
    links = cut(_met(alone, _linking(k, percent), columns))
    large = families.where(F.col("size") > FAMILY)
    if large.limit(1).count():
        tasks = _cross_tasks(large.select("key", "s").join(_named(nodes, links), "s"), FAMILY)
        across = tasks.join(large.select("s", "th"), "s").join(_texts(docs, large), "th")
        links = links.unionByName(cut(_met(across, _linking(k, percent), columns)))
    final = _named(nodes, links)

    least = sig.where("n > 0").groupBy("s").agg(F.min("doc_id").alias("least"))
    named = least.join(final, "s", "left").withColumn("comp", F.coalesce("comp", "s"))
    smallest = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    whose = named.join(smallest, "comp").select("s", "component_id")
    out = sig.select("doc_id", "th", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("s")).alias("s")).join(whose, "s", "left")
    return out.select("doc_id", "th", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


@own_names("doc_id", "text")
def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each component: the one whose id names it; documents without words all stay once."""
    named = link_components(docs, **options).where("doc_id <=> component_id")
    # without nulls in the keys the join's partitioning also serves the last step: texts are shuffled once
    own = F.coalesce("doc_id", F.lit(-2**63))
    named = named.select(own.alias("_id"), F.col("th").alias("_th")).distinct()
    keyed = docs.withColumns({"_id": own, "_th": F.xxhash64("text")})
    return keyed.join(named, ["_id", "_th"], "left_semi").dropDuplicates(["_id", "_th"]).select(*docs.columns)


def _bounder(percent: int):
    def run(batches):
        for batch in batches:
            t = batch.to_pydict()
            keep = []
            for n, m, x, y in zip(t["n"], t["m"], t["bs"], t["bl"]):
                if 100 * min(n, m) < percent * max(n, m):
                    keep.append(False)
                    continue
                words = min(len(x), len(y)) // 8
                p, q = (_folded(np.frombuffer(z, np.uint64).reshape(1, -1), words) for z in (x, y))
                loose = min(n - int(np.bitwise_count(p).sum()), m - int(np.bitwise_count(q).sum()))
                keep.append((100 + percent) * (int(np.bitwise_count(p & q).sum()) + loose) >= percent * (n + m))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("s")), batch.column(
                batch.schema.get_field_index("lead"))], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run
