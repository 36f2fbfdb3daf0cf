"""Line dedup by winnowing over line hashes, in DataFrame operations only.

A document is the sequence of the hashes of its non-blank lines, blanks at a
line's ends left out. A window is a least run of lines with ``min_words`` words:
one reaches forward from each line, and one back from each, up to the line that
fills it; where the document ends first there is none. Of each window the least
hash is selected, the last of equals, as its fingerprint. So whatever run of
lines fills a window has that window's fingerprint at the same place, wherever
it is repeated.

Fingerprints found at two places or more join these places. A match there is
extended both ways through the windows that selected it, forward and back. Every
line of a run with ``min_words`` words is in a window inside that run: the one
that reaches forward from it or, near the run's end, the one that reaches back
from the end. So the windows which an earlier place has too, taken together, are
the whole maximal runs of lines that are repeated, and these are deleted at all
places but the first, by (doc_id, text, line).

Guarantee: of two equal runs of lines with ``min_words`` words or more the later
is deleted, to its last line; no line outside of such a run is. Runs of a single
document count as well.

Defined results: a null text stays null and has no lines; an empty text has none
either; a text without a repeated run stays as it is; blank lines always stay;
long texts are taken whole; rows that agree in id and text are one document and
get one result each; of unlike texts with one id the order is that of a hash;
null ids come first; an empty table gives no rows; other columns are carried
along unchanged, and if one is called ``n_lines`` or ``n_removed`` the new one
gets a ``_`` behind its name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wharfline.llm.names import quoted, unused
from wharfline.session import materialise

MIN_WORDS = 5
#: Bytes of a deletion list that is sent to all tasks, and of one partition's that is hashed.
SENT_BYTES, HASHED_BYTES = 32 << 20, 64 << 20

_RAW = "split({t}, '\\n', -1)"
#: Non-blank lines as structs of their number from 1, and the trimmed line.
_FULL = f"filter(transform({_RAW}, (x, i) -> named_struct('no', i + 1, 'line', trim(BOTH ' ' FROM x))), s -> s.line != '')"


def _windows(docs: DataFrame, min_words: int) -> DataFrame:
    """(id, hash, at, size, anchor, print, w1, w2) of every window."""
    hashed = docs.select(
        "id",
        "hash",
        F.expr(f"transform({_FULL.format(t='text')}, s -> named_struct('h', xxhash64(s.line), 'g', hash(s.line), 'c', length(s.line) - length(replace(s.line, ' ', '')) + 1))").alias("u"),
    )
    # no filter on u here: it would be pushed down, and every line hashed twice
    full = f"aggregate(slice(c, {{a}}, n), 0, (s, x) -> s + x) >= {min_words}"
    reach = f"if(c[i - 1] >= {min_words}, 1, array_min(filter(sequence(2, least({min_words}, {{room}})), n -> {full})))"
    # a line that fills a window by itself has one; sequence(2, 1) would count down
    ahead = f"if(c[i - 1] < {min_words} and i = size(c), null, {reach.format(room='size(c) - i + 1', a='i')})"
    back = f"if(c[i - 1] >= {min_words} or i = 1, null, {reach.format(room='i', a='i - n + 1')})"
    spans = f"""CASE WHEN size(c) > 0 THEN filter(concat(
        transform(sequence(1, size(c)), i -> named_struct('at', i, 'size', {ahead})),
        transform(transform(sequence(1, size(c)), i -> named_struct('at', i, 'size', {back})), s -> named_struct('at', s.at - s.size + 1, 'size', s.size))
        ), s -> s.size is not null) END"""
    # bound by a lambda, u.c is taken out of the structs once rather than for every line
    sized = hashed.select("id", "hash", F.expr("u.h").alias("h"), F.expr("u.g").alias("g"), F.expr(f"transform(array(u.c), c -> {spans})[0]").alias("w"))
    least = "array_min(slice(h, s.at, s.size))"
    full = sized.select(
        "id",
        "hash",
        F.explode(
            F.expr(
                f"""transform(w, s -> named_struct('at', s.at, 'size', s.size, 'print', {least},
                    'anchor', s.at + s.size - cast(array_position(reverse(slice(h, s.at, s.size)), {least}) as int),
                    'w1', xxhash64(slice(h, s.at, s.size)), 'w2', hash(slice(g, s.at, s.size))))"""
            )
        ).alias("s"),
    )
    return full.select("id", "hash", "s.*")


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, hash, lines): which non-blank lines, from 1, to delete of which text."""
    i, t = F.col(quoted(doc_id)), F.col(quoted(text))
    keyed = docs.select(i.alias("id"), F.xxhash64(t).alias("hash"), t.alias("text")).where("text is not null")
    windows = materialise(_windows(keyed, min_words), "winnow")
    place = F.struct("id", "hash", "anchor")
    met = windows.groupBy("print").agg(F.min(place).alias("a"), F.max(place).alias("z")).where("not (a <=> z)").select("print")
    cand = windows.join(materialise(met, "prints-met"), "print", "left_semi").select("id", "hash", "at", "size", "w1", "w2")
    start = F.struct("id", "hash", "at")
    first = cand.groupBy("w1", "w2").agg(F.min(start).alias("a"), F.max(start).alias("z")).where("not (a <=> z)").select("w1", "w2", "a")
    later = cand.join(materialise(first, "first-windows"), ["w1", "w2"]).where(~start.eqNullSafe(F.col("a")))
    return later.select("id", "hash", F.explode(F.expr("sequence(at, at + size - 1)")).alias("line")).groupBy("id", "hash").agg(F.collect_set("line").alias("lines"))


def _sized(gone: DataFrame) -> DataFrame:
    """The deletion list, which has one row for each text, joined by its measured size."""
    rows, lines = gone.agg(F.count("*"), F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()
    held = 64 * rows + 8 * lines
    if held <= SENT_BYTES:
        return gone.hint("broadcast")
    parts = int(gone.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return gone.hint("shuffle_hash") if held <= parts * HASHED_BYTES else gone


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the later repeated runs gone from ``text``.

    Adds ``n_lines`` and ``n_removed``, both of non-blank lines.
    """
    gone = _sized(materialise(repeated_lines(docs, doc_id, text, min_words), "later-lines"))
    n_lines, n_removed, at_id, at_hash, at_lines = unused(docs.columns, "n_lines", "n_removed", "__id", "__hash", "__lines")
    gone = gone.select(F.col("id").alias(at_id), F.col("hash").alias(at_hash), F.col("lines").alias(at_lines))
    t = quoted(text)
    joined = docs.join(gone, F.col(quoted(doc_id)).eqNullSafe(F.col(at_id)) & (F.xxhash64(F.col(t)) == F.col(at_hash)), "left")
    # bound by a lambda, the lines are split once rather than for every line kept
    kept = F.expr(
        f"""CASE WHEN {at_lines} IS NULL THEN {t} ELSE transform(
            array(named_struct('raw', {_RAW.format(t=t)}, 'no', {_FULL.format(t=t)}.no)),
            z -> array_join(transform(
                array_except(sequence(1, size(z.raw)), transform({at_lines}, k -> element_at(z.no, k))),
                k -> element_at(z.raw, k)), '\n'))[0] END"""
    )
    count = F.when(F.col(t).isNull(), 0).otherwise(F.expr(f"size(filter({_RAW.format(t=t)}, x -> trim(BOTH ' ' FROM x) != ''))"))
    removed = F.when(F.col(at_lines).isNull(), 0).otherwise(F.size(at_lines))
    out = [kept.alias(text) if c == text else F.col(quoted(c)) for c in docs.columns]
    return joined.select(*out, count.cast("long").alias(n_lines), removed.cast("long").alias(n_removed))
