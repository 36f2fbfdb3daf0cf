"""Secret scans by corpus-wide ownership frequency, in DataFrame operations only.

Base spans are the non-overlapping matches, from the left, of three patterns;
their places follow from the lengths of the matches and of the pieces between.
They always stay. Besides, every long mixed token outside of them is a
candidate. Candidates are hashed, and for each hash the distinct owners and the
distinct repositories it occurs under are counted over the whole corpus: what
more than ``MAX_OWNERS`` owners or more than ``MAX_REPOS`` repositories have is a
widely copied example, what few of both have looks like a live credential. The
latter candidates are added as ``token`` spans.

Counting goes by (hash, owner, repository), then (hash, owner), then hash, each
with partial sums, so a token that a third of all rows copy is summed up before
it is shuffled.

Defined results: a null text is empty, and an empty text has no spans; long
texts are taken whole; a null owner or repository counts as one of its own;
spans that begin at the same place are in the order of their kinds; repeated
rows each get their own result and count as one place; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wharfline.llm.names import quoted
from wharfline.session import materialise

#: The base patterns by kind, in order; the group whose length counts; its least length.
PATTERNS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
CANDIDATE = r"[A-Za-z0-9+/_-]{24,}"
MIN_DISTINCT = 12
#: A value under more owners, or in more repositories, is widely copied.
MAX_OWNERS, MAX_REPOS = 2, 4


_SPANS = "array<struct<start: bigint, kind: int, end: bigint, value: string>>"
#: Where a pattern can match at all, by kind. Whatever fills a hexadecimal or a mixed token has 24 of its
#: characters on end; looking only where such a run begins takes one step a character.
_LONG = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24}"
_GUARDS = (" or ".join(f"contains(low, '{w}')" for w in ("passw", "secret", "token", "apikey", "api_key")), "contains(text, 'AKIA')", "long", "long")


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans(kind: int, pattern: str, group: int, least: int, guard: str) -> F.col:
    """Matches of one pattern as structs (start, kind, end, value).

    ``guard`` is a cheaper condition that holds where the pattern can match. The
    matches and the pieces between are found once each and bound by a lambda.
    """
    q = _quoted(pattern)
    found = f"regexp_extract_all(text, {q}, 0)"
    values = found.replace(", 0)", f", {group})") if group else "cast(null as array<string>)"
    # the piece after the last match is zipped with a null match and left out
    step = f"filter(arrays_zip(z.p, z.m{', z.v' if group else ''}), x -> x.m is not null)"
    value = "x.v" if group else "x.m"
    walk = f"""aggregate({step}, named_struct('at', cast(0 as bigint), 'out', cast(array() as {_SPANS})),
        (a, x) -> named_struct('at', a.at + length(x.p) + length(x.m), 'out', if(length({value}) >= {least},
            array_append(a.out, named_struct('start', a.at + length(x.p), 'kind', {kind}, 'end', a.at + length(x.p) + length(x.m), 'value', {value})), a.out)), a -> a.out)"""
    bound = f"transform(array(named_struct('m', {found}, 'v', {values}, 'p', split(text, {q}, -1))), z -> {walk})[0]"
    return F.expr(f"CASE WHEN {guard} THEN {bound} ELSE cast(array() as {_SPANS}) END")


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` (text and others) with ``base`` and ``found`` span arrays for its text."""
    base = F.array_sort(F.concat(*[_spans(k, p, g, n, _GUARDS[k]) for k, (_, p, g, n) in enumerate(PATTERNS)]))
    more = _spans(len(PATTERNS), CANDIDATE, 0, 24, _GUARDS[-1])
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(v, "(?!$)"))) >= MIN_DISTINCT)
    out = docs.withColumn("text", F.coalesce("text", F.lit("")))
    out = out.withColumns({"low": F.lower("text"), "long": F.col("text").rlike(_LONG)})
    out = out.withColumn("base", base).withColumn("found", more)
    free = lambda x: mixed(x["value"]) & ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    return out.withColumn("found", F.filter("found", free)).drop("text", "low", "long")


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_owners, n_repos) over the rows (hash, owner, repo)."""
    by_repo = found.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"))


def _written(spans: str) -> F.col:
    names = ", ".join(f"'{k}'" for k in [*(k for k, *_ in PATTERNS), "token"])
    return F.expr(f"array_join(transform({spans}, x -> concat(array({names})[x.kind], ':', x.start, ':', x.end)), ',')")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repo: str | None = None, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """One row per document.

    ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256`` and ``spans`` as the
    patterns and the frequencies give them; ``n_token`` added spans; of all
    candidates and base values ``n_live`` that few have, ``n_example`` widely
    copied; ``n_owners`` and ``n_repos`` of the value which most have, 0 if the
    document has none. A repository is an owner's ``repo`` value, or, where no
    column tells repositories, each of the owner's distinct texts.
    """
    col = lambda c: F.col(quoted(c))
    whole = F.coalesce(col(text).cast("string"), F.lit(""))
    named = docs.select(col(doc_id).alias("doc_id"), whole.alias("text"), col(owner).alias("owner"), (col(repo) if repo else F.xxhash64(whole)).alias("repo"))
    rows = materialise(candidates(named).withColumn("row", F.monotonically_increasing_id()), "secrets")
    every = rows.where("size(base) + size(found) > 0").select("row", "owner", "repo", F.explode(F.concat("base", "found")).alias("x"))
    every = every.select("row", "owner", "repo", F.xxhash64("x.value").alias("hash"), "x")
    seen = ownership(every.select("hash", "owner", "repo"))
    judged = every.join(materialise(seen, "ownership"), "hash").withColumn("live", (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos))
    added = F.when(F.col("live") & (F.col("x.kind") == len(PATTERNS)), F.col("x"))
    by_row = judged.groupBy("row").agg(
        F.collect_list(added).alias("added"), F.sum(F.col("live").cast("long")).alias("n_live"), F.sum((~F.col("live")).cast("long")).alias("n_example"), F.max("n_owners").alias("n_owners"), F.max("n_repos").alias("n_repos")
    )
    joined = rows.join(by_row, "row", "left")
    none = F.expr(f"cast(array() as {_SPANS})")
    joined = joined.withColumn("all", F.array_sort(F.concat("base", F.coalesce("added", none))))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return joined.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, (name, *_) in enumerate(PATTERNS)],
        F.sha2(_written("base"), 256).alias("base_sha256"),
        _written("all").alias("spans"),
        F.size(F.coalesce("added", none)).cast("long").alias("n_token"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_live", "n_example", "n_owners", "n_repos")],
    )
