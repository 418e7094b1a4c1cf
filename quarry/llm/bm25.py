"""Exact BM25 top-k: whole texts as queries, block-max pruning per shard, global statistics, the shards' best merged."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import cut, shared_folder
from quarry.llm.shingles import PLAIN, words_of

K1, B, K3 = 1.2, 0.75, 1.0
BLOCK_QUERIES = 8192      # queries that one pass over the postings answers
QUERY_BYTES = 64 << 20    # and their text at most
ROUND = 8                 # passes that share one reading of the texts
SHARD = 16384             # documents of a shard
TASK_SHARDS = 8           # shards that a task goes through, if there are tasks enough
RANGE = 256               # documents of a block
DENSE = 1024              # terms at most that are multiplied as a dense matrix
COMMON = 0.002            # product of a term's shares of documents and queries from which that is cheaper than a posting at a time
KINDS = 12                # kinds of documents that a shard is sorted by
KIND_TERMS = 256          # commonest terms that tell them
PIECE = 1 << 13          # postings added at once
HELD = 1 << 21            # candidates held before they are scored exactly
CHUNK = 1 << 16           # terms whose document counts travel in one row


def _terms(texts: pa.Array):
    """Yields, for each text, its number of words, its distinct term hashes and their counts."""
    # some texts at a time: hashing takes tens of bytes for each of theirs
    for start in range(0, len(texts), 64):
        low = pc.utf8_lower(texts.slice(start, 64).cast(pa.large_string()))
        for _, offsets, words in words_of(low, kind=PLAIN):
            words = words.view(np.int64)
            for a, b in zip(offsets[:-1], offsets[1:]):
                term, count = np.unique(words[a:b], return_counts=True)
                yield b - a, term, count


def _describe(batches):
    for batch in batches:
        terms, counts = [], []
        for _, term, count in _terms(batch.column(1)):
            terms.append(term.tobytes())
            counts.append(count.astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2), pc.binary_length(batch.column(1)).cast(pa.int64()),
                                          pa.array(terms, pa.binary()), pa.array(counts, pa.binary())], ["query_id", "deal", "size", "terms", "counts"])


def _distinct(batches):
    """The distinct terms of a task's queries, by their upper bits."""
    held = [np.frombuffer(x, np.int64) for batch in batches for x in batch.column(0).to_pylist()]
    terms = np.unique(np.concatenate([np.zeros(0, np.int64), *held]))
    part = terms >> 58
    edges = np.flatnonzero(np.diff(part, prepend=-64, append=64))
    if len(terms):
        yield pa.RecordBatch.from_arrays([pa.array(part[edges[:-1]].astype(np.int32)),
                                          pa.array([terms[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary())], ["part", "terms"])


def _joined(table: pa.Table) -> pa.Table:
    terms = np.unique(np.concatenate([np.frombuffer(x, np.int64) for x in table.column("terms").to_pylist()]))
    return pa.table({"part": table.column("part")[:1], "terms": pa.array([terms.tobytes()], pa.binary())})


def _poster(vocabulary, shard: int):
    """The documents' postings: numbers and counts of the vocabulary's terms, a shard after the other in the order of its kinds."""
    def run(batches):
        known = vocabulary.value
        ids, lengths, terms, counts = [], [], [], []

        def sorted_shard():
            size = np.array([len(t) for t in terms], np.int64)
            index = Index(np.concatenate(terms), np.concatenate(counts), size, np.array(lengths, np.float64), max(1.0, float(np.mean(lengths))))
            order = index.kinds(np.bincount(index.terms, minlength=len(known)) / len(ids))
            for a in range(0, len(order), 1024):
                some = order[a:a + 1024].tolist()
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in some], pa.int64()), pa.array([lengths[i] for i in some], pa.int64()),
                                                  pa.array([terms[i].tobytes() for i in some], pa.binary()), pa.array([counts[i].tobytes() for i in some], pa.binary())],
                                                 ["doc_id", "words", "terms", "counts"])

        for batch in batches:
            for i, (n, term, count) in zip(batch.column(0).to_pylist(), _terms(batch.column(1))):
                at = np.searchsorted(known, term)
                ok = at < len(known)
                ok[ok] = known[at[ok]] == term[ok]
                ids.append(i)
                lengths.append(int(n))
                terms.append(at[ok].astype(np.int32))
                counts.append(count[ok].astype(np.int32))
                if len(ids) == shard:
                    yield from sorted_shard()
                    ids, lengths, terms, counts = [], [], [], []
        if ids:
            yield from sorted_shard()
    return run


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit numbers of a binary column's rows one after the other, and how many each row has."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    return (np.frombuffer(raw, np.uint8)[at[0]:at[-1]] if raw is not None else np.zeros(0, np.uint8)).view(np.int32), np.diff(at) // 4


def _counter(terms: int):
    """Document counts of the ``terms`` numbered terms in a task's postings, in rows of ``CHUNK`` terms; row -1 has rows and words."""
    def run(batches):
        df, rows, words = np.zeros(terms, np.int64), 0, 0
        for batch in batches:
            rows, words = rows + batch.num_rows, words + (pc.sum(batch.column(0)).as_py() or 0)
            df += np.bincount(_numbers(batch.column(1))[0], minlength=terms)
        chunks = [(c, df[c * CHUNK:(c + 1) * CHUNK].tobytes()) for c in range(-(-terms // CHUNK))]
        chunks.append((-1, np.array([rows, words], np.int64).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in chunks], pa.int32()), pa.array([x for _, x in chunks], pa.binary())], ["chunk", "counts"])
    return run


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist())
    return pa.table({"chunk": table.column("chunk")[:1], "counts": pa.array([total.tobytes()], pa.binary())})


def _runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places ``first[i] .. first[i] + count[i] - 1`` of all ``i``, one run after the other."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(int(count.sum()))


class Queries:
    """Queries by term, as postings with weights in single precision, and by query."""

    def __init__(self, own: list, share: np.ndarray):
        self.names, self.share = [name for name, _, _ in own], share
        self.first = np.concatenate([[0], np.cumsum([len(t) for _, t, _ in own])])
        self.terms = np.concatenate([t for _, t, _ in own]).astype(np.int64)
        self.weights = np.concatenate([w for _, _, w in own])
        self.light = self.weights.astype(np.float32)
        by = np.argsort(self.terms, kind="stable")
        # a posting is a weight and a query beside each other, moved as one 64-bit number
        self.posts = np.empty((len(by), 2), np.int32)
        self.posts[:, 0] = self.light[by].view(np.int32)
        self.posts[:, 1] = np.repeat(np.arange(len(own)), np.diff(self.first))[by]
        self.posts = self.posts.view(np.int64).reshape(-1)
        self.starts = np.searchsorted(self.terms[by], np.arange(len(share) + 1))
        self.asked = np.diff(self.starts)
        # single precision: a sum of n positive products is off by (n + 3) roundings of 2^-24 at most, both ways for two scores
        self.slack = np.minimum(1, 2.1 * (np.diff(self.first) + 8) * 2.0 ** -24)

    def postings(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries and weights of the postings at ``places``."""
        both = self.posts.take(places)
        return both.view(np.int32)[1::2].astype(np.int64), both.view(np.float32)[::2]


class Index:
    """The documents of one shard with the impacts of the queries' terms."""

    def __init__(self, terms: np.ndarray, counts: np.ndarray, size: np.ndarray, length: np.ndarray, average: float):
        self.terms, self.size, self.first = terms, size, np.concatenate([[0], np.cumsum(size)])
        self.norm = K1 * (1 - B + B * length / average)
        self.counts = counts
        self.block: tuple = None, None, None

    def impacts(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the documents' postings, and their impacts."""
        post = _runs(self.first[docs], self.size[docs])
        tf = self.counts[post].astype(np.float64)
        return post, tf * (K1 + 1) / (tf + np.repeat(self.norm[docs], self.size[docs]))

    def postings(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms and impacts (single precision) of a block's postings; those of the last block are kept."""
        if self.block[0] is not docs:
            post, impact = self.impacts(docs)
            self.block = docs, self.terms[post].astype(np.int64), impact.astype(np.float32)
        return self.block[1:]

    def kinds(self, share: np.ndarray) -> np.ndarray:
        """The documents like beside like, so that a block's maxima belong to documents of one kind and about one length.

        Kinds are clusters of the documents' common terms (spherical k-means over a sample, the same at every call); within a
        kind documents are sorted by length.
        """
        common = np.argpartition(-share, min(KIND_TERMS, len(share)) - 1)[:KIND_TERMS] if len(share) else np.zeros(0, np.int64)
        column = np.full(len(share), -1, np.int64)
        column[common] = np.arange(len(common))
        rarity = np.log1p(1 / np.maximum(share[common], 1e-9))

        def vectors(docs):
            post = _runs(self.first[docs], self.size[docs])
            at, of = column[self.terms[post]], np.repeat(np.arange(len(docs)), self.size[docs])
            on = at >= 0
            out = np.zeros((len(docs), len(common)), np.float32)
            out[of[on], at[on]] = np.sqrt(self.counts[post[on]]) * rarity[at[on]]
            return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

        n = len(self.size)
        sample = vectors(np.unique(np.linspace(0, n - 1, min(2048, n)).astype(np.int64)))
        centres = sample[np.unique(np.linspace(0, len(sample) - 1, min(KINDS, len(sample))).astype(np.int64))]
        for _ in range(4):
            nearest = (sample @ centres.T).argmax(axis=1)
            sums = np.stack([sample[nearest == j].sum(axis=0) for j in range(len(centres))])
            centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        # each kind beside the one most like it: most blocks across two kinds are then of one language
        chain, alike = [0], centres @ centres.T
        while len(chain) < len(centres):
            alike[:, chain[-1]] = -1
            chain.append(int(alike[chain[-1]].argmax()))
        centres = centres[chain]
        kind = np.concatenate([(vectors(np.arange(a, min(n, a + 2048))) @ centres.T).argmax(axis=1) for a in range(0, n, 2048)])
        return np.lexsort((self.norm, kind))

    def order(self, share: np.ndarray) -> np.ndarray:
        """The documents in the order of their blocks: a block from all over the shard, which gives every query a first bar, then by kind."""
        return _spread(self.kinds(share))

    def bounds(self, queries: Queries, docs: np.ndarray) -> np.ndarray:
        """For every query what no document of the block can exceed: its weights times the block's greatest impact of each term."""
        most = np.zeros(len(queries.share), np.float32)
        np.maximum.at(most, *self.postings(docs))
        out = np.add.reduceat(most.take(queries.terms) * queries.light, queries.first[:-1])
        return out.astype(np.float64) * (1 + queries.slack) + 1e-8

    def near(self, queries: Queries, docs: np.ndarray, alive: np.ndarray) -> np.ndarray:
        """Scores of the documents (rows) for the queries ``alive`` (columns) in single precision, within the queries' slack.

        Terms common in the block and among the queries are multiplied as dense matrices, the others go a document at a time
        through the queries' postings.
        """
        width, size = len(docs), self.size[docs]
        term, impact = self.postings(docs)
        both = np.bincount(term, minlength=len(queries.share)) * queries.asked
        common = np.flatnonzero(both >= COMMON * width * len(alive))
        if len(common) > DENSE:
            common = np.sort(common[np.argsort(-both[common], kind="stable")[:DENSE]])
        column = np.full(len(queries.share), -1, np.int64)
        column[common] = np.arange(len(common))
        place = np.full(len(queries.names), len(alive))
        place[alive] = np.arange(len(alive))
        # a column more than there are queries alive takes what belongs to the others
        weights = np.zeros((len(common), len(alive) + 1), np.float32)
        for a in range(0, len(common), 64):
            some = common[a:a + 64]
            who, weight = queries.postings(_runs(queries.starts[some], queries.asked[some]))
            weights[np.repeat(np.arange(a, a + len(some)), queries.asked[some]), place.take(who)] = weight
        at = column.take(term)
        dense = at >= 0
        matrix = np.zeros((width, len(common)), np.float32)
        matrix[np.repeat(np.arange(width), size)[dense], at[dense]] = impact[dense]
        out = matrix @ weights[:, :-1]
        rare = np.flatnonzero(~dense)
        edges = np.searchsorted(rare, np.concatenate([[0], np.cumsum(size)]))
        term, impact = term[rare], impact[rare]
        count = queries.asked[term]
        ends = np.concatenate([[0], np.cumsum(count)])
        first, ends = queries.starts[term] - ends[:-1], ends[edges]
        # as many documents at once as have about PIECE postings to add
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(ends[1:] // PIECE)) + 1, [width]])
        step = np.arange(np.diff(ends[cuts]).max(initial=0))
        for x, y in zip(cuts[:-1], cuts[1:]):
            if ends[x] == ends[y]:
                continue
            own = slice(edges[x], edges[y])
            places = np.repeat(first[own] + ends[x], count[own])
            places += step[:len(places)]
            who, weight = queries.postings(places)
            value = np.repeat(impact[own], count[own])
            value *= weight
            if y - x > 1:
                who += np.repeat(np.arange(0, (y - x) * len(queries.names), len(queries.names)), np.diff(ends[x:y + 1]))
            more = np.zeros((y - x, len(queries.names)), np.float32)
            np.add.at(more.reshape(-1), who, value)
            out[x:y] += more.take(alive, axis=1)
        return out

    def exact(self, queries: Queries, who: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Scores of pairs, ordered by query, in double precision and in the order of the terms."""
        slot, out = np.full(len(queries.share), -1, np.int32), np.zeros(len(who))
        edges = np.flatnonzero(np.diff(who, prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:]):
            own = slice(queries.first[who[a]], queries.first[who[a] + 1])
            term, weight = queries.terms[own], queries.weights[own]
            slot[term] = np.arange(len(term))
            for c in range(a, b, RANGE):
                some = docs[c:min(b, c + RANGE)]
                post = _runs(self.first[some], self.size[some])
                at = slot.take(self.terms.take(post))
                on = np.flatnonzero(at >= 0)
                of = np.searchsorted(np.cumsum(self.size[some]), on, "right")
                tf = self.counts[post[on]].astype(np.float64)
                out[c:c + len(some)] = np.bincount(of, tf * (K1 + 1) / (tf + self.norm[some][of]) * weight[at[on]], len(some))
            slot[term] = -1
        return np.round(out, 9)

    def search(self, queries: Queries, k: int, ids: np.ndarray, least: np.ndarray | None = None,
               order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``query, document, score`` of each query's ``k`` best (smaller id first among equals); documents without a term don't count.

        Block-max pruning: documents lie in blocks of ``RANGE``; a block is scored only for the queries whose bound there, by
        the block's greatest impact of each term, reaches their running ``k``-th best.  Scores are taken in single precision;
        what may be among the ``k`` best, given the bound of that rounding, is scored again exactly; nothing else can be.
        Documents that score below ``least`` (single precision) are left out; it is raised to what the ``k`` best found here reach.
        """
        least = np.zeros(len(queries.names)) if least is None else least
        who, docs, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        order, last = self.order(queries.share) if order is None else order, 0
        self.pairs, self.scored = 0, 0
        for a in range(0, len(ids), RANGE):
            own = order[a:a + RANGE]
            b = a + len(own)
            bound = self.bounds(queries, own)
            alive = np.flatnonzero((bound > 1e-8) & (bound >= least))
            self.pairs, self.scored = self.pairs + len(least), self.scored + len(alive)
            if len(alive):
                near = self.near(queries, own, alive)
                floor = least[alive].astype(np.float32)
                if not a and b > k:
                    first = (np.partition(near, b - k, axis=0)[b - k] * (1 - queries.slack[alive]) - 1e-8).astype(np.float32)
                    floor = np.maximum(floor, first)
                # one more rounding step down, as the floor is itself rounded; scores of nothing are 0
                hit = np.flatnonzero(near >= np.maximum(np.nextafter(floor, np.float32(-1)), np.float32(1e-30)))
                d, q = np.divmod(hit, len(alive))
                who, docs, score = np.append(who, alive[q]), np.append(docs, own[d]), np.append(score, near.reshape(-1)[hit])
            if not a or b == len(ids) or len(who) - last > len(least):
                who, docs, score = self._kept(queries, k, who, docs, score, least)
                if len(who) > HELD:
                    who, docs, score = self._best(queries, k, ids, who, docs, score)[:3]
                last = len(who)
        who, docs, _, exact = self._best(queries, k, ids, who, docs, score)
        return who, docs, exact

    @staticmethod
    def _kept(queries, k, who, docs, score, least):
        """The candidates that may still be among the ``k`` best; raises ``least``."""
        order = np.lexsort((-score, who))
        who, docs, score = who[order], docs[order], score[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        kth = rank == k - 1
        own = who[kth]
        least[own] = np.maximum(least[own], score[kth].astype(np.float64) * (1 - queries.slack[own]) - 1e-8)
        ok = score >= least[who]
        return who[ok], docs[ok], score[ok]

    def _best(self, queries, k, ids, who, docs, score):
        order = np.argsort(who, kind="stable")
        who, docs, score = who[order], docs[order], score[order]
        exact = self.exact(queries, who, docs)
        order = np.lexsort((ids[docs], -exact, who))
        order = order[np.arange(len(who)) - np.searchsorted(who, who) < k]
        return who[order], docs[order], score[order], exact[order]


def _whole(parts: list) -> np.ndarray:
    """The parts as one array; the list is empty then."""
    out = np.concatenate(parts)
    parts.clear()
    return out


def _spread(like: np.ndarray) -> np.ndarray:
    """A block from all over ``like`` first, then the rest as it is."""
    first = np.zeros(len(like), bool)
    first[np.unique(np.linspace(0, len(like) - 1, min(RANGE, len(like))).astype(np.int64))] = True
    return np.concatenate([like[first], like[~first]])


def _searcher(plan, k: int, shard: int):
    """A task goes through its postings a shard after the other; each answers every query, above what those before it have given."""
    def run(batches):
        number, average, queries = plan.value
        least = np.zeros(len(queries.names))
        best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0)
        names, lengths, terms, counts, sizes, rows = [], [], [], [], [], 0

        def with_shard():
            ids = pa.chunked_array(names).combine_chunks()
            none, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(-2**63).to_numpy()
            index = Index(_whole(terms), _whole(counts), _whole(sizes), _whole(lengths).astype(np.float64), average)
            who, docs, score = index.search(queries, k, ids, least, _spread(np.arange(len(ids))))
            who, found, none, score = (np.concatenate(x) for x in zip(best, (who, ids[docs], none[docs], score)))
            order = np.lexsort((found, -score, who))
            rank = np.arange(len(who)) - np.searchsorted(who[order], who[order])
            kth = order[rank == k - 1]
            least[who[kth]] = np.maximum(least[who[kth]], score[kth] * (1 - queries.slack[who[kth]]) - 1e-8)
            order = order[rank < k]
            return who[order], found[order], none[order], score[order]

        for batch in batches:
            term, size = _numbers(batch.column(2))
            at = number.take(term)
            ok = at >= 0
            held = np.concatenate([[0], np.cumsum(ok)])
            ends = np.cumsum(size)
            names.append(batch.column(0))
            lengths.append(batch.column(1).to_numpy())
            terms.append(at[ok])
            counts.append(_numbers(batch.column(3))[0][ok])
            sizes.append(held[ends] - held[ends - size])
            rows += batch.num_rows
            if rows >= shard:
                best = with_shard()
                names, rows = [], 0
        if rows:
            best = with_shard()
        who, found, none, score = best
        for a in range(0, len(who), 1 << 16):
            some = slice(a, a + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(queries.names, pa.int64()).take(pa.array(who[some])), pa.array(found[some], mask=none[some]), pa.array(score[some])],
                                             ["query_id", "doc_id", "score"])
    return run


def _answer(posted: DataFrame, rows: list, vocabulary: np.ndarray, df: np.ndarray, n: int, words: int, k: int, query_terms: int | None,
            shard: int) -> DataFrame | None:
    """One pass, done and written when it returns: only its own queries are broadcast meanwhile."""
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    chosen = []
    for r in rows:
        at = np.searchsorted(vocabulary, np.frombuffer(r.terms, np.int64))
        count = np.frombuffer(r.counts, np.int32)
        weight = idf[at] * (K3 + 1) * count / (K3 + count)
        best = np.sort(np.lexsort((at, -weight))[:query_terms])
        if len(best):
            chosen.append((r.query_id, at[best], weight[best]))
    if not chosen:
        return None
    used = np.unique(np.concatenate([a for _, a, _ in chosen]))
    number = np.full(len(vocabulary), -1, np.int32)
    number[used] = np.arange(len(used))
    queries = Queries([(name, number[a], w) for name, a, w in chosen], df[used] / max(1, n))
    plan = posted.sparkSession.sparkContext.broadcast((number, max(1.0, words / max(1, n)), queries))
    found = cut(posted.mapInArrow(_searcher(plan, k, shard), "query_id long, doc_id long, score double"))
    plan.destroy()
    return found


def _round(docs: DataFrame, asked: DataFrame, passes: range, k: int, query_terms: int | None, shards: int, shard: int) -> list:
    """Some passes: the texts are read once, as postings of these passes' terms, which all of them search."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    asked = asked.where(F.col("pass").between(passes[0], passes[-1]))
    parts = asked.select("terms").mapInArrow(_distinct, "part int, terms binary").groupBy("part").applyInArrow(_joined, "part int, terms binary").collect()
    vocabulary = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(r.terms, np.int64) for r in sorted(parts, key=lambda r: r.part)]])
    if not len(vocabulary):
        return []
    held = sc.broadcast(vocabulary)
    path = shared_folder(spark, "postings")
    (docs.coalesce(shards).mapInArrow(_poster(held, shard), "doc_id long, words long, terms binary, counts binary")
     .write.option("parquet.block.size", 8 << 20).parquet(path))
    held.destroy()
    tasks = max(2 * sc.defaultParallelism, shards // TASK_SHARDS)
    posted = spark.read.parquet(path).coalesce(tasks)
    counted = (posted.select("words", "terms").mapInArrow(_counter(len(vocabulary)), "chunk int, counts binary")
               .groupBy("chunk").applyInArrow(_added, "chunk int, counts binary").collect())
    total = {r.chunk: np.frombuffer(r.counts, np.int64) for r in counted}
    n, words = (int(x) for x in total.pop(-1))
    df = np.concatenate([total[c] for c in sorted(total)])
    found = [_answer(posted, asked.where(F.col("pass") == p).select("query_id", "terms", "counts").collect(),       # BLOCK_QUERIES rows or so
                     vocabulary, df, n, words, k, query_terms, shard) for p in passes]
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
    return found


def search(docs: DataFrame, queries: DataFrame, k: int = 10, query_terms: int | None = None, block: int = BLOCK_QUERIES,
           shard: int = SHARD) -> DataFrame:
    """``query_id, rank, doc_id, score``: the ``k`` best of all ``docs`` (``doc_id, text``) for each query (``query_id, text``).

    A query is every distinct term of its whole text, its weight idf times a saturated count (``query_terms``: only so many,
    those with the highest weight).  BM25 is exact: document counts, the number of documents and their mean length are
    counted over all rows first, so scores of different shards agree and the best of the shards' best are the best of all.
    The texts are read once for ``ROUND`` passes and written as postings of the terms that these passes' queries ask for, in
    shards of about ``shard`` documents (input partitions are joined, never shuffled) sorted by kind.  A task holds one shard
    at a time.  Its documents lie in blocks with the greatest impact of each term; a block is scored only
    for the queries that it may still give one of their ``k`` best, in single precision (common terms as a
    matrix product, the others by postings), and again in double precision those that its rounding leaves among the best.
    Queries are answered in blocks of about ``block`` and ``QUERY_BYTES``, one pass over the postings each, so what travels
    with the tasks is bounded; time grows with queries times documents.

    Equal scores rank the smaller id first, null ids first.  A null or empty text is found by nothing and asks for
    nothing; a query that repeats wholly is answered once; equal documents are each found.  Empty tables give no rows.
    Other columns do not matter.
    """
    docs = docs.select("doc_id", "text")
    asked = queries.select("query_id", "text").where("text IS NOT NULL").distinct()
    asked = cut(asked.select("query_id", "text", F.xxhash64("query_id", "text").alias("deal"))
                .mapInArrow(_describe, "query_id long, deal long, size long, terms binary, counts binary"))
    n, (q, size) = docs.count(), asked.agg(F.count("*"), F.sum("size")).first()
    passes, shards = max(-(-q // block), -(-(size or 0) // QUERY_BYTES)), max(1, -(-n // shard))
    asked = asked.withColumn("pass", F.pmod("deal", F.lit(max(1, passes))))
    found = []
    for p in range(0, passes, ROUND):
        found += _round(docs, asked, range(p, min(passes, p + ROUND)), k, query_terms, shards, shard)
    found = [f for f in found if f is not None]
    schema = "query_id long, rank int, doc_id long, score double"
    if not found:
        return docs.sparkSession.createDataFrame([], schema)
    best = reduce(DataFrame.unionByName, found)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return best.select("query_id", rank.alias("rank"), "doc_id", "score").where(F.col("rank") <= k)
