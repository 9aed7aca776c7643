"""Repeated passages by De Bruijn compaction over token k-mers.

The graph's edges are windows of ``k`` words (its nodes the ``k - 1`` words two windows share).  Only edges that several
documents hold matter, and nothing else is ever shuffled:

1. Every window names its minimizer, the ``ANCHOR``-word gram with the smallest hash inside it.  Equal windows name equal
   grams, so a window can only repeat where its gram does.  Grams (about one in four or five words) meet by hash; those
   found in one document only are dropped.
2. Windows of repeated grams become edges, named by 128 bits.  A task first merges the copies in its own batch, then edges
   meet by name.  The first holder ``(doc_id, row, position)`` of an edge is its source.
3. Consecutive edges of a document whose sources are consecutive too compact into one span with one source coordinate.
4. Where a span begins or ends, its source run branches.  Joining runs with those places cuts them into the nonbranching
   paths of the graph (``paths``).
5. Spans are verified at their coordinates: the source reads its words again, and a digest of the words themselves (not of
   the hashes that found them) must agree.

Documents with equal word sequences are one class.  Its smallest doc_id takes part; the others repeat it from end to end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinprofile.llm.common import Steps, settle, without

K = 13
ANCHOR = 5
PART = 500  # documents whose windows a worker looks at together
MEMO = 200_000

_RNG = np.random.default_rng(31_013)
_ODD = _RNG.integers(0, 1 << 63, (3, 256), np.uint64) << np.uint64(1) | np.uint64(1)
_PLACE = np.uint64(0x9E3779B97F4A7C15)

ROW = "doc long, t long, "
FOUND = f"kind string, {ROW}w1 long, w2 long, n_words long, anchor long, high long, pos int"
OTHERS = pa.list_(pa.struct([("doc", pa.int64()), ("t", pa.int64()), ("pos", pa.int32())]))


class _Words(dict):
    """Hash of a word, kept up to a number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs without the six ASCII white space characters, unchanged."""
    return (text or "").encode("utf-8", "surrogatepass").split()


class Batch:
    """Word hashes of some documents one after another, and their windows."""

    def __init__(self, texts: list[str | None], known: dict[bytes, int], k: int) -> None:
        self.words = [words_of(t) for t in texts]
        self.sizes = np.fromiter(map(len, self.words), np.int64, len(texts))
        self.first = np.r_[0, np.cumsum(self.sizes)]
        self.hash = np.fromiter((known[w] for own in self.words for w in own), np.uint64, int(self.first[-1]))
        self.k = k
        self.owner = np.repeat(np.arange(len(texts)), self.sizes)

    def starts(self) -> np.ndarray:
        """Where a window of one document begins."""
        if len(self.hash) < self.k:
            return np.empty(0, np.int64)
        return np.flatnonzero(self.owner[: len(self.owner) - self.k + 1] == self.owner[self.k - 1 :])

    def grams(self) -> np.ndarray:
        """Hash of the anchor gram at every place (of later places too short for one, nothing)."""
        m = min(ANCHOR, self.k)
        n = len(self.hash) - m + 1
        total = np.zeros(max(0, n), np.uint64)
        for j in range(m if n > 0 else 0):
            total += self.hash[j : n + j] * _ODD[0, j]
        return _mix(total)

    def minimizers(self, grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Place of the smallest gram in the window that begins at each of ``starts``, the first of equal ones."""
        best, at = grams[starts], starts.copy()
        for j in range(1, self.k - min(ANCHOR, self.k) + 1):
            other = grams[starts + j]
            lower = other < best
            best = np.where(lower, other, best)
            at[lower] = starts[lower] + j
        return at

    def names(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The 128 bits that name the window at each of ``starts``."""
        one, two = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
        for j in range(self.k):
            h = self.hash[starts + j]
            one += h * _ODD[1, j % 256] + _PLACE * np.uint64(j // 256)
            two += (h ^ h >> np.uint64(29)) * _ODD[2, j % 256]
        return _mix(one), _mix(two ^ _PLACE)


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))


def _told_apart(rows: DataFrame, several: DataFrame | None, doc: str, text: str, t: str) -> DataFrame:
    """``rows`` with ``t``, which tells texts of one id apart: 0 for an id with one text, else a hash of the text."""
    if several is None:
        return rows.withColumn(t, F.lit(0).cast("long"))
    marked = several.select(F.col("doc").alias(f"{doc}_of_several"))
    joined = rows.join(marked, F.col(doc) == F.col(f"{doc}_of_several"), "left")
    return joined.withColumn(t, F.when(F.col(f"{doc}_of_several").isNull(), F.lit(0)).otherwise(F.xxhash64(text))).drop(f"{doc}_of_several")


def _source(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").cast("string").alias("text"))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        for at in range(0, rows.num_rows, PART):
            yield rows.slice(at, PART)


def _first_pass(source: DataFrame, k: int) -> DataFrame:
    """Rows 'doc' (class key and size of every row), 'gram' (anchors to be met) and 'hit' (anchors known to repeat).

    A 'gram' row with a position stands for one document; one without says which documents of the batch hold the gram.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        known = _Words()
        names = ["kind", "doc", "t", "w1", "w2", "n_words", "anchor", "high", "pos"]

        def batch(kind: str, n: int, **columns) -> pa.RecordBatch:
            types = [pa.string(), *[pa.int64()] * 7, pa.int32()]
            given = [columns.get(c, pa.nulls(n, t)) for c, t in zip(names[1:], types[1:])]
            return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.string()), *given], names)

        for part in _parts(batches):
            own = Batch(part.column("text").to_pylist(), known, k)
            digest = [xxhash.xxh3_128_digest(b" ".join(w)) for w in own.words]
            both = np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
            yield batch(
                "doc", part.num_rows, doc=part.column("doc"), t=part.column("t"), w1=pa.array(both[:, 0]), w2=pa.array(both[:, 1]),
                n_words=pa.array(own.sizes),
            )
            named = ~part.column("doc").is_null().to_numpy(zero_copy_only=False)
            doc = part.column("doc").fill_null(0).to_numpy()
            t = part.column("t").to_numpy()
            smallest: dict[bytes, int] = {}
            for d, i in sorted((doc[i], i) for i in np.flatnonzero(named).tolist()):
                smallest.setdefault(digest[i], d)
            lead = np.array([bool(n) and smallest[digest[i]] == doc[i] for i, n in enumerate(named.tolist())], bool)
            starts = own.starts()
            starts = starts[lead[own.owner[starts]]] if len(starts) else starts
            if not len(starts):
                continue
            grams = own.grams()
            at = np.unique(own.minimizers(grams, starts))
            gram, row = grams[at], own.owner[at]
            order = np.lexsort((at, t[row], doc[row], gram))
            at, gram, row = at[order], gram[order], row[order]
            new = np.r_[True, (gram[1:] != gram[:-1]) | (doc[row[1:]] != doc[row[:-1]]) | (t[row[1:]] != t[row[:-1]])]
            at, gram, row = at[new], gram[new], row[new]  # the first place of a gram in a row
            begin = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
            size = np.diff(np.r_[begin, len(gram)])
            low, high = doc[row[begin]], doc[row[begin + size - 1]]
            several = low < high
            hit = np.repeat(several, size)
            pos = (at - own.first[row]).astype(np.int32)
            yield batch("gram", int(several.sum()), doc=pa.array(low[several]), anchor=_signed(gram[begin][several]), high=pa.array(high[several]))
            for kind, some in (("hit", hit), ("gram", ~hit)):
                yield batch(
                    kind, int(some.sum()), doc=pa.array(doc[row[some]]), t=pa.array(t[row[some]]), anchor=_signed(gram[some]),
                    pos=pa.array(pos[some]),
                )

    return source.select("doc", "t", "text").mapInArrow(run, FOUND)


def _edges(chosen: DataFrame, k: int) -> DataFrame:
    """Edges ``(e1, e2, doc, t, pos, others)`` of rows ``(doc, t, text, hits)``: first holder in the batch, and the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        known = _Words()
        for part in _parts(batches):
            own = Batch(part.column("text").to_pylist(), known, k)
            starts = own.starts()
            lists = part.column("hits")
            hits = lists.flatten().to_numpy().astype(np.int64)
            count = np.diff(lists.offsets.to_numpy())
            hits = hits + np.repeat(own.first[:-1], count)
            if not len(starts) or not len(hits):
                continue
            grams = own.grams()
            at = own.minimizers(grams, starts)
            # The hit is the first place of its gram in the document; all its places count.
            local = lambda p: grams[p] + _PLACE * own.owner[p].astype(np.uint64)
            starts = starts[np.isin(local(at), local(hits))]
            e1, e2 = own.names(starts)
            row = own.owner[starts]
            doc, t = part.column("doc").to_numpy()[row], part.column("t").to_numpy()[row]
            order = np.lexsort((starts, t, doc, e2, e1))
            e1, e2, doc, t, row, starts = (x[order] for x in (e1, e2, doc, t, row, starts))
            same = (e1[1:] == e1[:-1]) & (e2[1:] == e2[:-1])
            once = np.r_[True, ~(same & (doc[1:] == doc[:-1]) & (t[1:] == t[:-1]))]  # an edge's first place in a row
            lead = np.r_[True, ~same][once]
            e1, e2, doc, t, row, starts = (x[once] for x in (e1, e2, doc, t, row, starts))
            pos = (starts - own.first[row]).astype(np.int32)
            other = ~lead
            structs = pa.StructArray.from_arrays(
                [pa.array(doc[other]), pa.array(t[other]), pa.array(pos[other])], fields=list(OTHERS.value_type)
            )
            offsets = np.r_[0, np.cumsum(np.diff(np.r_[np.flatnonzero(lead), len(lead)]) - 1)].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [_signed(e1[lead]), _signed(e2[lead]), pa.array(doc[lead]), pa.array(t[lead]), pa.array(pos[lead]),
                 pa.ListArray.from_arrays(pa.array(offsets), structs)],
                ["e1", "e2", "doc", "t", "pos", "others"],
            )

    one = "struct<doc:long,t:long,pos:int>"
    return chosen.select("doc", "t", "text", "hits").mapInArrow(run, f"e1 long, e2 long, {ROW}pos int, others array<{one}>")


def _digests(wanted: DataFrame, k: int) -> DataFrame:
    """Digest of the words at every ``(pos, n)`` of rows ``(doc, t, text, places)``, places being ``n`` windows long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            out: list[tuple] = []
            for doc, t, text, places in zip(*(part.column(c).to_pylist() for c in ("doc", "t", "text", "places"))):
                words = words_of(text)
                for place in places:
                    own = words[place["pos"] : place["pos"] + place["n"] + k - 1]
                    out.append((doc, t, place["pos"], place["n"], xxhash.xxh3_128_digest(b" ".join(own), 7)))
            columns = list(zip(*out)) or [()] * 5
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc", "t", "pos", "n", "digest"])

    return wanted.select("doc", "t", "text", "places").mapInArrow(run, f"{ROW}pos int, n int, digest binary")


class Repeats:
    """What ``find`` has written: ``rows`` (one per input row: class and size) and verified ``spans``."""

    def __init__(self, several: DataFrame | None, rows: DataFrame, spans: DataFrame, k: int) -> None:
        self.several, self.rows, self.spans, self.k = several, rows, spans, k

    def paths(self) -> DataFrame:
        """Nonbranching repeated paths ``(doc_id, start, n_words, n_spans)`` by the coordinates of their source.

        Every place where a span begins or ends on a source run is a branch (or an end) of the repeated graph; the run is
        cut there, and each piece is read by the number of spans that cross it.  ``start`` counts words from 0.
        """
        ends = self.spans.select(F.col("sdoc").alias("doc"), F.col("st").alias("t"), F.col("spos").alias("a"), (F.col("spos") + F.col("n")).alias("b"))
        step = ends.select("doc", "t", F.col("a").alias("at"), F.lit(1).alias("d")).union(ends.select("doc", "t", "b", F.lit(-1)))
        # An edge begins at ``at``; between two neighbouring places the number of crossing spans does not change.
        places = step.groupBy("doc", "t", "at").agg(F.sum("d").alias("d"))
        run = Window.partitionBy("doc", "t").orderBy("at")
        cut = places.withColumns({"n_spans": F.sum("d").over(run), "next": F.lead("at").over(run)}).where("n_spans > 0")
        return cut.select(
            F.col("doc").alias("doc_id"), F.col("at").cast("long").alias("start"),
            (F.col("next") - F.col("at") + self.k - 1).cast("long").alias("n_words"), "n_spans",
        )


def find(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = K) -> Repeats:
    """Spans of at least ``k`` words that also stand in a document with a smaller id, and the classes of equal documents.

    ``spans`` has ``(doc, t, pos, n, sdoc, st, spos)``: ``n`` windows from word ``pos`` of row ``(doc, t)`` are the windows
    from word ``spos`` of the source; ``t`` tells different texts of one id apart (``_told_apart``).  A window that a
    document holds several times stands in the spans by its first place.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    steps = Steps(docs.sparkSession)
    source = _source(docs, text, key)
    texts_of = source.select("doc", F.xxhash64("text").alias("h")).where("doc is not null").groupBy("doc").agg(F.min("h").alias("a"), F.max("h").alias("b"))
    several = steps.write(texts_of.where("a <> b").select("doc"), "several")
    if several.isEmpty():  # then no step needs to tell rows of one id apart
        several = None
    source = _told_apart(source, several, "doc", "text", "t")
    found = steps.write(_first_pass(source, k), "grams")
    own = found.where("kind = 'doc'").select("doc", "t", "w1", "w2", "n_words")
    classes = own.where("doc is not null").groupBy("w1", "w2").agg(F.min("doc").alias("lead"))
    rows = steps.write(
        own.join(classes, ["w1", "w2"], "left").select("doc", "t", "n_words", (F.col("doc") > F.col("lead")).alias("copy")), "rows"
    )
    taking = rows.where("not copy").select("doc", "t").distinct()

    by_gram = Window.partitionBy("anchor")
    met = found.where("kind = 'gram'").select("doc", "t", "pos", "anchor", F.coalesce("high", "doc").alias("high"))
    met = met.withColumns({"lowest": F.min("doc").over(by_gram), "highest": F.max("high").over(by_gram)})
    met = met.where("lowest < highest and pos is not null").select("doc", "t", "pos")
    hits = found.where("kind = 'hit'").select("doc", "t", "pos").union(met).groupBy("doc", "t").agg(F.collect_list("pos").alias("hits"))
    hits = steps.write(hits.join(taking, ["doc", "t"], "left_semi"), "hits")
    steps.drop(found)

    # Rows that repeat an id and its text are one.
    texts = source.where("doc is not null")
    chosen = texts.join(hits, ["doc", "t"])
    by_name = Window.partitionBy("e1", "e2").orderBy("doc", "t", "pos")
    holder = F.struct("doc", "t", "pos")
    edges = _edges(chosen, k).withColumn("source", F.first(holder).over(by_name))
    each = edges.select("source", F.explode(F.concat(F.array(holder), "others")).alias("own")).where("own.doc > source.doc")
    each = each.select("own.*", F.col("source.doc").alias("sdoc"), F.col("source.t").alias("st"), F.col("source.pos").alias("spos")).distinct()

    along = Window.partitionBy("doc", "t").orderBy("pos")
    before = lambda c: F.lag(c).over(along)
    goes_on = (
        (before("pos") == F.col("pos") - 1) & (before("spos") == F.col("spos") - 1) & (before("sdoc") == F.col("sdoc"))
        & (before("st") == F.col("st"))
    )
    marked = each.withColumn("new", F.when(goes_on, 0).otherwise(1))
    marked = marked.withColumn("run", F.sum("new").over(along))
    compact = marked.groupBy("doc", "t", "run").agg(
        F.min("pos").alias("pos"), F.count(F.lit(1)).cast("int").alias("n"), F.first("sdoc").alias("sdoc"), F.first("st").alias("st"),
        F.min("spos").alias("spos"),
    ).drop("run")
    spans = steps.write(compact, "spans")
    steps.drop(hits)

    # Both ends of a span read their words.
    ends = spans.select("doc", "t", F.struct("pos", "n").alias("place"))
    ends = ends.union(spans.select("sdoc", "st", F.struct(F.col("spos").alias("pos"), "n"))).groupBy("doc", "t").agg(F.collect_set("place").alias("places"))
    read = steps.write(_digests(texts.dropDuplicates(["doc", "t"]).join(ends, ["doc", "t"]), k), "digests")
    mine = read.select("doc", "t", "pos", "n", F.col("digest").alias("here"))
    theirs = read.select(F.col("doc").alias("sdoc"), F.col("t").alias("st"), F.col("pos").alias("spos"), "n", F.col("digest").alias("there"))
    good = spans.join(mine, ["doc", "t", "pos", "n"]).join(theirs, ["sdoc", "st", "spos", "n"]).where("here = there")
    verified = steps.write(good.select("doc", "t", "pos", "n", "sdoc", "st", "spos"), "verified")
    for table in (read, spans):
        steps.drop(table)
    return Repeats(several, rows, verified, k)


def covered(own: Batch, places: list[list[dict]]) -> list[np.ndarray]:
    """For every document which of its words lie in a window that begins in one of its places, or equals such a window."""
    starts = own.starts()
    e1, e2 = own.names(starts)
    wanted = np.array(
        [own.first[i] + p["pos"] + j for i, mine in enumerate(places) for p in mine or () for j in range(p["n"])], np.int64
    )
    local = _mix(e1 ^ e2 * _ODD[0, 7]) + _PLACE * own.owner[starts].astype(np.uint64)
    gone = np.isin(local, local[np.searchsorted(starts, wanted)])
    change = np.zeros(len(own.hash) + 1, np.int64)
    change[starts[gone]] += 1
    np.subtract.at(change, starts[gone] + own.k, 1)
    inside = np.cumsum(change)[:-1] > 0
    return [inside[a:b] for a, b in zip(own.first[:-1].tolist(), own.first[1:].tolist())]


ADDED = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()),
])


def drop_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = K) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` and ``kept_text``: words of windows found in a smaller document are gone.

    Windows are ``k`` consecutive words of one document, judged on the input; kept words are joined by one space.  A null or
    empty text, or one without words, has no words and an empty ``kept_text``.  Fewer than ``k`` words are never removed.
    Rows that repeat an id are one document: they never remove each other's words.  A row with a null id keeps all its words
    and takes none.  Other columns stay as they are; columns called like an added one are replaced.
    """
    found = find(docs, text, key, k)
    spans = found.spans.groupBy("doc", "t").agg(F.collect_list(F.struct("pos", "n")).alias("places"))
    verdict = found.rows.where("copy").select("doc", "t", "copy").distinct().join(spans, ["doc", "t"], "full")
    taken = {c.lower() for c in docs.columns}
    free = lambda name: name if name not in taken else free(f"{name}_")
    doc, t, body, copy, places = map(free, ("own_doc", "own_t", "own_text", "own_copy", "own_places"))
    kept = without(docs, ADDED.fieldNames()) if text.lower() not in {n.lower() for n in ADDED.fieldNames()} else without(docs, ["n_words", "n_removed"])
    out_names = kept.columns
    rows = kept.withColumns({doc: F.col(f"`{key}`").cast("long"), body: F.col(f"`{text}`").cast("string")})
    rows = _told_apart(rows, found.several, doc, body, t)
    verdict = verdict.select(F.col("doc").alias(doc), F.col("t").alias(t), F.col("copy").alias(copy), F.col("places").alias(places))
    joined = rows.join(verdict, [doc, t], "left").select(*[f"`{c}`" for c in out_names], body, copy, places)
    fields = [f for f in joined.schema.fields if f.name in out_names and f.name.lower() != "kept_text"]
    schema = T.StructType(fields + ADDED.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settle()
        known = _Words()
        for part in _parts(batches):
            copies, marked = part.column(copy).to_pylist(), part.column(places).to_pylist()
            texts = part.column(body).to_pylist()
            sizes, removed, left = [0] * len(texts), [0] * len(texts), [""] * len(texts)
            some = [i for i, p in enumerate(marked) if p]
            inside = dict(zip(some, covered(Batch([texts[i] for i in some], known, k), [marked[i] for i in some])))
            for i, value in enumerate(texts):
                words = words_of(value)
                sizes[i] = len(words)
                if copies[i] and len(words) >= k:
                    removed[i] = len(words)
                    continue
                if i in inside:
                    removed[i] = int(inside[i].sum())
                    words = [w for w, gone in zip(words, inside[i].tolist()) if not gone]
                left[i] = b" ".join(words).decode("utf-8", "surrogatepass")
            new = [pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(left, pa.string())]
            yield pa.RecordBatch.from_arrays([part.column(f.name) for f in fields] + new, schema.fieldNames())

    return joined.mapInArrow(run, schema)
