"""Secrets in texts, judged by how widely their values are owned.

One scan finds candidates with their places. Equal values are then counted
over the whole corpus by distinct repositories and owners, each text counting
once, where it stands first: a value that several owners hold in yet more
repositories is a copied example, any other looks live. All of it is DataFrame
expressions.

A pattern's matches are the pieces between the gaps that a split leaves, so
places are running sums of the lengths of gaps and matches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from barlab.llm.session import checkpointed

# fixed values: the base patterns, and formats that services document
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_HEAD = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
SERVICE = r"gh[opusr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|[rs]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+|-----BEGIN\x20[A-Z\x20]*PRIVATE\x20KEY-----"
BLOB = r"[A-Za-z0-9+/_-]{24,}"

KINDS = ("assign", "access", "hex", "service", "blob")
_SPAN = "array<struct<start:bigint,rank:int,end:bigint,value:string>>"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _before(values: Column, add: Callable[[Column, Column], Column], zero: int = 0, block: int = 256) -> Column:
    """For each element the ``add`` of all earlier ones (a sum, maximum or minimum): by blocks, so a long array costs n * block steps."""
    total = lambda a: F.aggregate(a, F.lit(zero).cast("bigint"), lambda s, x: add(s, x))

    def with_blocks(blocks: Column) -> Column:
        heads = F.transform(blocks, lambda _, b: total(F.slice(blocks, F.lit(1), b)))
        return bound(heads, lambda h: F.transform(values, lambda _, i: add(F.get(h, F.floor(i / block).cast("int")), total(F.slice(values, F.floor(i / block).cast("int") * block + 1, i % block)))))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int")), lambda b: total(F.slice(values, b * block + 1, F.lit(block))))
    return F.when(F.size(values) > 0, bound(blocks, with_blocks)).otherwise(F.array().cast("array<bigint>"))


_ADD = lambda s, x: s + x
_END_OF_TIME = 1 << 62


def _apart(spans: Column, others: Column) -> Column:
    """Spans that overlap none of the others: one sweep over both in the order of their starts."""
    mark = lambda a, own: F.transform(a, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(own).alias("own"), x["rank"].alias("rank"), x["value"].alias("value")))

    def sweep(both: Column) -> Column:
        ends = F.transform(both, lambda x: F.when(x["own"] == 1, F.lit(0).cast("bigint")).otherwise(x["end"]))
        starts = F.transform(F.reverse(both), lambda x: F.when(x["own"] == 1, F.lit(_END_OF_TIME)).otherwise(x["start"]))
        last, first = _before(ends, F.greatest), F.reverse(_before(starts, F.least, _END_OF_TIME))
        fits = lambda e, n: F.filter(both, lambda x, i: (x["own"] == 1) & (F.get(e, i) <= x["start"]) & (F.get(n, i) >= x["end"]))
        kept = bound(last, lambda e: bound(first, lambda n: fits(e, n)))
        return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["value"].alias("value")))

    swept = bound(F.sort_array(F.concat(mark(spans, 1), mark(others, 0))), sweep)
    return F.when((F.size(spans) == 0) | (F.size(others) == 0), spans).otherwise(swept)


def _matches(text: Column, pattern: str, rank: int, value: Callable[[Column], Column], test: Callable[[Column], Column] | None = None) -> Column:
    """Spans of the pattern's leftmost matches that do not overlap; those failing ``test`` on the value are dropped."""
    none = F.array().cast(_SPAN)

    def spans(found: Column) -> Column:
        make = lambda g, z, s: F.transform(found, lambda m, i: F.struct((F.get(s, i) + F.get(g, i)).alias("start"), F.lit(rank).alias("rank"), (F.get(s, i) + F.get(z, i)).alias("end"), value(m).alias("value")))
        gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("bigint"))
        sizes = lambda g: F.transform(found, lambda m, i: F.get(g, i) + F.length(m).cast("bigint"))
        return bound(gaps, lambda g: bound(sizes(g), lambda z: bound(_before(z, _ADD), lambda s: make(g, z, s))))

    kept = lambda a: a if test is None else F.filter(a, lambda x: test(x["value"]))
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    return F.when(F.rlike(text, F.lit(pattern)), kept(bound(found, spans))).otherwise(none)


def _looks_random(v: Column) -> Column:
    return F.rlike(v, F.lit("[0-9]")) & F.rlike(v, F.lit("[a-z]")) & F.rlike(v, F.lit("[A-Z]"))


def scan(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with base (assign, access and hex spans) and more (service spans outside the base ones, and blob spans outside both).

    A null or empty text has none; rows are judged one by one, repeated ones
    alike; where matches of one kind could start at the same place, the longest
    is taken, and an earlier kind wins over a later one. Columns of these two
    names are replaced; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = docs.withColumn("__t", text).select(
        "*",
        _matches(F.col("__t"), ASSIGN, 0, lambda m: F.regexp_replace(m, ASSIGN_HEAD, ""), lambda v: F.length(v) >= 8).alias("__assign"),
        _matches(F.col("__t"), ACCESS, 1, lambda m: m).alias("__access"),
        _matches(F.col("__t"), HEX, 2, lambda m: m).alias("__hex"),
        _matches(F.col("__t"), SERVICE, 3, lambda m: m).alias("__service"),
        _matches(F.col("__t"), BLOB, 4, lambda m: m, _looks_random).alias("__blob"),
    )
    based = found.select(*[c for c in docs.columns if c not in ("base", "more")], F.sort_array(F.concat("__assign", "__access", "__hex")).alias("base"), "__service", "__blob")
    served = based.withColumn("__service", _apart(F.col("__service"), F.col("base")))
    outside = _apart(F.col("__blob"), F.concat("base", "__service"))
    return served.select(*[c for c in docs.columns if c not in ("base", "more")], "base", F.sort_array(F.concat("__service", outside)).alias("more"))


def ownership(values: DataFrame) -> DataFrame:
    """Distinct texts, repositories and owners of each value: value, n_texts, n_repos, n_owners.

    ``values``: value, text_hash, owner, repo. Copies of a text count once, at
    the first owner and repository that hold it. Each step combines before the
    shuffle, and a value that a third of all rows hold is spread by its texts.
    """
    homes = values.groupBy("value", "text_hash").agg(F.min(F.struct("owner", "repo")).alias("home"))
    repos = homes.groupBy("value", "home").agg(F.count(F.lit(1)).alias("n"))
    owners = repos.groupBy("value", F.col("home.owner").alias("owner")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("repos"))
    return owners.groupBy("value").agg(F.sum("n").alias("n_texts"), F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repo: Column | None = None, example_owners: int = 3, example_repos: int = 5, salts: int = 16) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, base, added (arrays of spans), live (spans whose value looks live).

    A span is struct(start, rank, end, value): code points, end exclusive,
    rank into KINDS. A value that ``example_owners`` owners hold, in
    ``example_repos`` repositories or more, is an example, any other is live.
    Base spans (assign, access, hex) are always reported, spans of further
    kinds are added if their value is live. ``owner`` and ``repo`` say whose a
    row is; by default they are the column ``source``, and it with ``lang``,
    and a table without these columns is an error unless they are given.
    A null text is empty, a null owner or repository a name of its own; null
    and repeated ids and repeated rows are rows like any other; an empty table
    gives none. Columns of other names are ignored.
    """
    owner = F.col("source") if owner is None else owner
    repo = F.concat_ws("/", owner, F.col("lang")) if repo is None else repo
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    plain = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), name(owner).alias("owner"), name(repo).alias("repo"))
    found = scan(plain)
    hashed = lambda a: F.transform(a, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), F.sha2(x["value"], 256).alias("value")))
    rows = checkpointed(found.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "owner", "repo", F.xxhash64("text").alias("text_hash"), hashed("base").alias("base"), hashed("more").alias("more")))
    spans = rows.select("rid", "text_hash", "owner", "repo", F.explode(F.concat("base", "more")).alias("span")).select("rid", "text_hash", "owner", "repo", "span", F.col("span.value").alias("value"))
    example = (F.col("n_owners") >= example_owners) & (F.col("n_repos") >= example_repos)
    counts = ownership(spans).select("value", (~example).alias("is_live"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    judged = spans.withColumn("salt", F.pmod(F.col("rid"), F.lit(salts)).cast("int")).join(counts, ["value", "salt"])
    by_row = judged.where("is_live").groupBy("rid").agg(F.sort_array(F.collect_list("span")).alias("live"))
    joined = rows.join(by_row, "rid", "left").withColumn("live", F.coalesce("live", F.array().cast(_SPAN)))
    return joined.select("doc_id", "text_hash", "base", F.filter("live", lambda x: x["rank"] > 2).alias("added"), "live")


def spell(spans: Column) -> Column:
    """kind:start:end of sorted spans, joined by commas."""
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kind, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    count = lambda rank: F.size(F.filter("base", lambda x: x["rank"] == rank)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(spell(F.col("base")), 256).alias("base_sha256"),
        spell(F.sort_array(F.concat("base", "added"))).alias("spans"),
        F.size("live").cast("long").alias("n_live"),
    )


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with each live-looking value's span replaced by ``mask``; widely copied examples stay.

    Spans that overlap are masked as one. Rows and all other columns stay as
    they are; a text without live values, and a null text, is unchanged.
    ``options``: those of find_secrets; it needs to know owner and repository.
    """
    found = find_secrets(docs, id_col=id_col, text_col=text_col, **options)
    live = found.where(F.size("live") > 0).groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.first("live").alias("__live"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    joined = docs.withColumn("__h", F.xxhash64(text)).join(live, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__hash")), "left")
    out = F.when(F.col("__live").isNull(), F.col(text_col)).otherwise(_masked(F.col(text_col), F.col("__live"), mask))
    return joined.select(*[F.col(c) if c != text_col else out.alias(text_col) for c in docs.columns])


def _masked(text: Column, spans: Column, mask: str, block: int = 1024) -> Column:
    """``text`` with sorted spans replaced. What lies between them is cut from blocks of the text, so no cut walks through all of it."""

    def cut(parts: Column, a: Column, b: Column) -> Column:
        i, j = F.floor(a / block).cast("int"), F.floor(b / block).cast("int")
        part = lambda k: F.coalesce(F.get(parts, k), F.lit(""))
        inside = lambda k, at, n: F.substring(part(k), (at % block + 1).cast("int"), n.cast("int"))
        whole = F.array_join(F.slice(parts, i + 2, F.greatest(j - i - 1, F.lit(0))), "")
        return F.when(i == j, inside(i, a, b - a)).otherwise(F.concat(inside(i, a, F.lit(block)), whole, inside(j, F.lit(0), b % block)))

    def between(parts: Column, last: Column) -> Column:
        heads = F.filter(F.transform(spans, lambda x, i: F.struct(F.get(last, i).alias("a"), x["start"].alias("b"))), lambda g: g["b"] >= g["a"])
        end = F.array_max(F.transform(spans, lambda x: x["end"]))
        return F.concat(F.array_join(F.transform(heads, lambda g: F.concat(cut(parts, g["a"], g["b"]), F.lit(mask))), ""), cut(parts, end, F.length(text).cast("bigint")))

    last = _before(F.transform(spans, lambda x: x["end"]), F.greatest)
    return bound(F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{block}}})"), F.lit(1)), lambda parts: bound(last, lambda e: between(parts, e)))


_q = lambda p: p.replace("'", "''")

ORACLE = rf"""
WITH k(rank, kind, pat) AS (VALUES (0, 'assign', '{_q(ASSIGN)}'), (1, 'access', '{_q(ACCESS)}'), (2, 'hex', '{_q(HEX)}'), (3, 'service', '{_q(SERVICE)}'), (4, 'blob', '{_q(BLOB)}')),
t AS (SELECT doc_id, md5(coalesce(text, '')) AS body, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repo, rank, kind, regexp_extract_all(coalesce(text, ''), pat) AS m, regexp_split_to_array(coalesce(text, ''), pat) AS g FROM documents, k),
u AS (SELECT doc_id, body, owner, repo, rank, kind, m, g, unnest(m) AS v, generate_subscripts(m, 1) AS i FROM t),
p AS (SELECT doc_id, body, owner, repo, rank, kind, v, CASE WHEN rank = 0 THEN regexp_replace(v, '{_q(ASSIGN_HEAD)}', '') ELSE v END AS value,
             list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s FROM u),
c AS (SELECT doc_id, body, owner, repo, rank, kind, sha256(value) AS value, s::BIGINT AS s, (s + length(v))::BIGINT AS e FROM p
      WHERE (rank <> 0 OR length(value) >= 8) AND (rank <> 4 OR (regexp_matches(value, '[0-9]') AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')))),
a AS (SELECT * FROM c WHERE rank < 3),
b AS (SELECT * FROM c WHERE rank = 3 AND NOT EXISTS (SELECT 1 FROM a WHERE a.doc_id = c.doc_id AND a.s < c.e AND c.s < a.e)),
d AS (SELECT * FROM c WHERE rank = 4 AND NOT EXISTS (SELECT 1 FROM (SELECT * FROM a UNION ALL SELECT * FROM b) o WHERE o.doc_id = c.doc_id AND o.s < c.e AND c.s < o.e)),
f AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM d),
h AS (SELECT value, owner, repo FROM (SELECT value, owner, repo, row_number() OVER (PARTITION BY value, body ORDER BY owner, repo) AS i FROM f) WHERE i = 1),
n AS (SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT (owner, repo)) AS repos FROM h GROUP BY value),
j AS (SELECT f.*, NOT (owners >= 3 AND repos >= 5) AS live FROM f JOIN n USING (value)),
r AS (SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
             count(*) FILTER (WHERE live) AS n_live,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (WHERE rank < 3) AS base,
             string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (WHERE rank < 3 OR live) AS spans FROM j GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM documents d LEFT JOIN r USING (doc_id)
"""
