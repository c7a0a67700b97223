"""Secret scans with corpus-wide ownership frequency.

Base spans come from three patterns. Beside them, long tokens that mix letters and digits, or whose kinds of characters
change as often as in random base64, are candidates. Every candidate value is hashed and counted by the distinct
repositories and owners that hold it. A value of several owners is a copied example, and so is one that its single owner
has in several repositories; every other value looks live. Tokens of fewer than COPIED_OWNERS owners are added as spans
of kind ``owned`` where no base span overlaps them; base spans always stay.

DataFrame functions only. Texts are scanned once into the gaps between matches and their lengths, which are written;
positions are running sums over these, and overlaps are running extremes, so a text of very many matches costs no more
a match than any other, to find and to redact. A value found in a third of all documents costs one row per task and owner when counted, and
its rows may be split where they meet its verdict.

Null texts are empty. A null owner counts as the owner ''. Repeated rows are judged each for itself. An
empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm._shared import saved

#: The patterns of the contract. The two of one run are given by their least length.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_ASSIGNED = 6
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
#: A token is a candidate with so many digits and letters at least.
LEAST_DIGITS, LEAST_LETTERS = 4, 4
KINDS = ("assign", "access", "hex", "owned")
#: A value that so many owners hold is a copied example.
COPIED_OWNERS = 3
#: So is a value that its only owner has in so many repositories.
COPIED_REPOSITORIES = 3
#: Percentage of a token's letters and digits after which lower case, upper case and digits change; random base64 has 64.
LEAST_CHANGES = 30
_MATCH = "array<struct<kind:int,place:int,gap:int,more:int,length:int,value:string>>"


def _matches(text: Column, pattern: str, kind: int, value, wanted=None) -> Column:
    """Of all matches, in order: what lies between it and the one before (characters, and bytes beyond one each), its length, and the
    hash of its value, null if it is not wanted."""
    # Zipped before the lambda, which would split the text again for every match; what follows the last match has none.
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")
    gaps = F.split(text, pattern, -1).alias("gap")

    def match(x: Column, i: Column) -> Column:
        m, gap = x["found"], x["gap"]
        hashed = F.sha2(value(m), 256)
        length = F.length(gap)
        return F.struct(F.lit(kind).alias("kind"), i.alias("place"), length.alias("gap"), (F.octet_length(gap) - length).alias("more"), F.length(m).alias("length"), (hashed if wanted is None else F.when(wanted(m), hashed)).alias("value"))

    return F.when(text.rlike(pattern), F.transform(F.filter(F.arrays_zip(found, gaps), lambda x: x["found"].isNotNull()), match)).otherwise(F.array().cast(_MATCH))


def all_matches(text: Column) -> Column:
    """The matches of all four kinds; those whose value is too short, and tokens that are no candidates, have no value."""
    assigned = lambda m: F.regexp_extract(m, ASSIGN, 2)
    whole = lambda m: m
    return F.concat(
        _matches(text, ASSIGN, 0, assigned, lambda m: F.length(assigned(m)) >= LEAST_ASSIGNED),
        _matches(text, ACCESS, 1, whole), _matches(text, HEX, 2, whole), _matches(text, TOKEN, 3, whole, _candidate),
    )


def _candidate(m: Column) -> Column:
    mixed = (F.length(F.regexp_replace(m, "[^0-9]", "")) >= LEAST_DIGITS) & (F.length(F.regexp_replace(m, "[^A-Za-z]", "")) >= LEAST_LETTERS)
    plain = F.regexp_replace(m, "[^A-Za-z0-9]", "")
    runs = F.size(F.regexp_extract_all(plain, F.lit("[a-z]+|[A-Z]+|[0-9]+"), F.lit(0)))
    return mixed | ((F.length(plain) > 0) & (100 * (runs - 1) >= LEAST_CHANGES * F.length(plain)))


def placed(matches: DataFrame) -> DataFrame:
    """Spans of rows (_row, kind, place, gap, more, length, value, and others): adds start and end, and by how much bytes are ahead, leaves out matches without a value
    and tokens that a base span overlaps. The rows of a document meet in one task, sorted; nothing else is held."""
    at = Window.partitionBy("_row", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    spans = matches.repartition("_row").withColumn("end", F.sum(F.col("gap") + F.col("length")).over(at).cast("int")).withColumn("ahead", F.sum("more").over(at).cast("int"))
    spans = spans.withColumn("start", F.col("end") - F.col("length")).where("value IS NOT NULL")
    base = F.col("kind") < 3
    before = Window.partitionBy("_row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("_row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, -1)
    near = spans.withColumn("_ended", F.max(F.when(base, F.col("end"))).over(before)).withColumn("_next", F.min(F.when(base, F.col("start"))).over(after))
    apart = (F.coalesce("_ended", F.lit(0)) <= F.col("start")) & (F.coalesce("_next", F.col("end")) >= F.col("end"))
    return near.where(base | apart).drop("place", "gap", "more", "length", "_ended", "_next")


def span_list(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])))


def ownership(candidates: DataFrame) -> DataFrame:
    """value, owners, repositories: distinct holders of every hash, from rows (value, owner, repository)."""
    repositories = candidates.select("value", "owner", "repository").distinct()
    owners = repositories.groupBy("value", "owner").agg(F.count("*").alias("n"))
    return owners.groupBy("value").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", owner: Column | None = None, repository: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, the columns of keep, found (array of start, kind, end, live, copied, and in bytes first, last, after; in order).

    owner defaults to the column source, the repository to source and lang.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", F.col("source"), F.col("lang")) if repository is None else repository
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    read = docs.select(F.col(id_column).alias("_id"), text.alias("_text"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), F.coalesce(repository.cast("string"), F.lit("")).alias("repository"), F.struct(*keep).alias("_keep") if keep else F.lit(None).alias("_keep"))
    kept = ["_id", "owner", "repository", *["_keep"] * bool(keep)]
    # Written rows, so the row number is the same whenever it is read again.
    table = saved(read.select(*kept, all_matches(F.col("_text")).alias("matches")).withColumn("_row", F.monotonically_increasing_id()))
    candidates = saved(placed(table.select("_row", "owner", "repository", F.explode("matches").alias("m")).select("_row", "owner", "repository", "m.*")))
    judged = candidates.join(ownership(candidates), "value")
    copied = (F.col("owners") >= COPIED_OWNERS) | ((F.col("owners") == 1) & (F.col("repositories") >= COPIED_REPOSITORIES))
    wanted = judged.where((F.col("kind") < 3) | (F.col("owners") < COPIED_OWNERS))
    # first and last are bytes, after is the last byte of all spans before, so that texts can be cut without counting characters.
    before = Window.partitionBy("_row").orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, -1)
    cut = wanted.withColumn("first", F.col("start") + F.col("ahead")).withColumn("last", F.col("end") + F.col("ahead")).withColumn("after", F.coalesce(F.max("last").over(before), F.lit(0)))
    rows = cut.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", (~copied).alias("live"), copied.alias("copied"), "first", "last", "after"))).alias("found"))
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,live:boolean,copied:boolean,first:int,last:int,after:int>>")
    found = F.coalesce("found", empty)
    back = table.select("_row", *[k for k in kept if k not in ("owner", "repository")]).join(rows, "_row", "left")
    return back.select(F.col("_id").alias(id_column), *[F.col(f"_keep.{k}").alias(k) for k in keep], F.filter(found, lambda s: s["kind"] < 3).alias("base"), found.alias("found"))


def secret_table(docs: DataFrame, **columns) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, and n_live and n_copied of the spans."""
    count = lambda spans, ok: F.size(F.filter(spans, ok)).cast("long")
    of_kind = lambda k: lambda s: s["kind"] == k
    found = scan(docs, **columns)
    return found.select(
        found.columns[0], *[count("base", of_kind(k)).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(span_list(F.col("base")), 256).alias("base_sha256"), span_list(F.col("found")).alias("spans"),
        count("found", lambda s: s["live"]).alias("n_live"), count("found", lambda s: s["copied"]).alias("n_copied"),
    )


def redact(text: Column, found: Column) -> Column:
    """The text with every span, overlapping ones as one, replaced by its class."""
    mark = lambda s: F.when(s["copied"], "[EXAMPLE]").otherwise("[SECRET]")

    def cut(raw: Column) -> Column:
        """Matches are ASCII, so all cuts are between characters. Spans that begin before others end are part of these."""
        before = F.transform(F.filter(found, lambda s: s["first"] >= s["after"]), lambda s: F.concat(F.substring(raw, s["after"] + 1, s["first"] - s["after"]).cast("string"), mark(s)))
        end = F.array_max(F.transform(found, lambda s: s["last"]))
        return F.concat(F.array_join(before, ""), F.substring(raw, end + 1, F.length(raw) - end).cast("string"))

    # Bound as a lambda's variable, so the text becomes bytes once.
    whole = F.get(F.transform(F.array(text.cast("binary")), cut), 0)
    return F.when(F.size(found) > 0, whole).otherwise(text)


def redacted(docs: DataFrame, text_column: str = "text", **columns) -> DataFrame:
    """The rows of docs with all spans of the text replaced by their class; null texts stay null."""
    found = scan(docs.withColumn("_all", F.struct(*docs.columns)), text_column=text_column, keep=("_all",), **columns)
    text = F.col(f"_all.{text_column}")
    return found.select(*[redact(text, F.col("found")).alias(c) if c == text_column else F.col(f"_all.{c}").alias(c) for c in docs.columns])


def oracle_sql() -> str:
    literal = lambda s: "'" + s.replace("'", "''") + "'"

    def kind(number: int, pattern: str, value: str, ok: str) -> str:
        p = literal(pattern)
        return f"""SELECT r, {number} AS kind, s - length(m) AS start, s AS stop, sha256({value}) AS value FROM (
  SELECT r, unnest(m) AS m, unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x)))))::INTEGER AS s
  FROM (SELECT r, regexp_extract_all(text, {p}, 0) AS m, string_split_regex(text, {p}) AS g FROM docs)) WHERE {ok}"""

    assigned = f"regexp_extract(m, {literal(ASSIGN)}, 2)"
    plain = "regexp_replace(m, '[^A-Za-z0-9]', '', 'g')"
    mixed = (
        f"(length(regexp_replace(m, '[^0-9]', '', 'g')) >= {LEAST_DIGITS} AND length(regexp_replace(m, '[^A-Za-z]', '', 'g')) >= {LEAST_LETTERS}"
        f" OR length({plain}) > 0 AND 100 * (len(regexp_extract_all({plain}, '[a-z]+|[A-Z]+|[0-9]+')) - 1) >= {LEAST_CHANGES} * length({plain}))"
    )
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS owner, concat_ws('/', source, lang) AS repository FROM documents),
base AS ({kind(0, ASSIGN, assigned, f'length({assigned}) >= {LEAST_ASSIGNED}')} UNION ALL {kind(1, ACCESS, 'm', 'true')} UNION ALL {kind(2, HEX, 'm', 'true')}),
tokens AS (SELECT * FROM ({kind(3, TOKEN, 'm', mixed)}) t WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = t.r AND b.start < t.stop AND t.start < b.stop)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM tokens),
held AS (SELECT value, count(DISTINCT owner) AS owners, count(DISTINCT [owner, repository]) AS repositories FROM every JOIN docs USING (r) GROUP BY value),
named AS (SELECT e.*, owners, kind < 3 OR owners < {COPIED_OWNERS} AS shown, owners >= {COPIED_OWNERS} OR owners = 1 AND repositories >= {COPIED_REPOSITORIES} AS copied, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || start || ':' || stop AS name FROM every e JOIN held USING (value)),
per AS (SELECT r, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS k, count(*) FILTER (kind = 2) AS h,
  string_agg(name, ',' ORDER BY start, kind) FILTER (kind < 3) AS b, string_agg(name, ',' ORDER BY start, kind) FILTER (shown) AS s,
  count(*) FILTER (shown AND NOT copied) AS live, count(*) FILTER (shown AND copied) AS copied FROM named GROUP BY r)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256,
  coalesce(s, '') AS spans, coalesce(live, 0) AS n_live, coalesce(copied, 0) AS n_copied FROM docs LEFT JOIN per USING (r)"""
