"""Secret scan with corpus-wide ownership frequency, in DataFrame expressions only.

Every text is scanned for three kinds of base spans (assignments, access keys, long hex runs) and for
free candidates: runs of letters and digits that mix both. Each candidate value is hashed, and the
corpus is asked how many distinct owners, repositories and texts hold it. A value that many owners or
repositories copy, or many texts of one owner, is an example; one that stays with a single owner in few
repositories and texts, is long and varied, and is not already part of a base span looks live and
becomes a further span of kind ``owned``. Base spans always stay; how their values are spread is
reported beside them.

A match's place follows from the lengths of the pieces between matches, in code points; matches are
folded in runs of ``RUN``, so a text of very many matches is not copied once per match. The distinct
counts are taken in two steps, first by value and what is counted, then by value with partial counts in
the tasks, so a value that a third of all texts holds never gathers in one task; candidates meet their
figures again in a join by value, whose skewed keys adaptive execution splits.

Defined results: a null text is empty; a null repository or owner counts as one of its own; repeated
rows are scanned row by row but add nothing to distinct counts, nor do equal texts under other ids to
that of texts; null ids are kept; texts are scanned whole at any length; an empty table gives no rows;
further columns are ignored by ``scan`` and kept by ``redact``, whatever their names.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areapanel.session import staged

# Fixed values of the base scan.
ASSIGN_HEAD = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
ASSIGN = ASSIGN_HEAD + r"([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # runs are maximal, so shorter ones need not be matched at all
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "owned")

#: A free candidate, and what makes its value live-looking and its spread narrow.
CANDIDATE_LEAST = 16
LEAST_VARIETY = 8
MOST_OWNERS, MOST_REPOSITORIES, MOST_TEXTS = 1, 2, 8
#: From so many owners or repositories on, or beyond ``MOST_TEXTS`` texts, a value counts as a copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 5

#: Matches of one text that are folded together.
RUN = 256

#: Texts with spans, and spans of one text, up to which the spans go to the texts; more are joined.
BROADCAST_TEXTS, BROADCAST_SPANS = 1 << 16, 64

SPAN = "struct<kind:int,start:int,end:int,value:string>"
NONE = f"array<{SPAN}>"


def _found(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """Spans of all leftmost non-overlapping matches of a pattern; ``value`` is the group's text."""
    gaps = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    each = F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), value.alias("value"))
    each = F.filter(each, lambda x: x["whole"].isNotNull())

    def step(state, x):
        begin = state["at"] + F.length(x["gap"])
        end = begin + F.length(x["whole"])
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    def run(state, part):
        begin = F.struct(state["at"].alias("at"), F.array().cast(NONE).alias("spans"))
        found = F.aggregate(part, begin, step)
        # One element, so that the run is folded once for both fields.
        return F.get(F.transform(F.array(found), lambda f: F.struct(
            f["at"].alias("at"), F.concat(state["runs"], F.array(f["spans"])).alias("runs")
        )), F.lit(0))

    def runs(matches):
        last = F.greatest(F.size(matches) - 1, F.lit(0))
        numbers = F.sequence(F.lit(0), F.floor(last / RUN).cast("int"))
        return F.transform(numbers, lambda i: F.slice(matches, i * RUN + 1, RUN))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{NONE}>").alias("runs"))
    folded = F.transform(F.array(each), lambda matches: F.aggregate(runs(matches), begin, run, lambda state: F.flatten(state["runs"])))
    return F.get(folded, F.lit(0))


def _only(text: Column, clue: str, pattern: str, kind: int, test, group: int = 0) -> Column:
    """As ``_found`` with a filter; the costly part only runs on texts that hold the clue."""
    spans = F.filter(_found(text, pattern, kind, group), test)
    return F.when(text.rlike(clue), spans).otherwise(F.array().cast(NONE))


def base_spans(text: Column) -> Column:
    """Base spans of all three kinds, by start, then kind."""
    assign = _only(text, ASSIGN_HEAD + "[A-Za-z0-9+/_.=-]", ASSIGN, 0, lambda s: F.length(s["value"]) >= ASSIGN_LEAST, 1)
    access = _only(text, r"AKIA[A-Z0-9]{16}", ACCESS, 1, lambda s: s["end"] - s["start"] >= ACCESS_LEAST)
    hexes = _only(text, r"[0-9a-f]{24}", HEX, 2, lambda s: s["end"] - s["start"] >= HEX_LEAST)
    return _ordered(F.concat(assign, access, hexes))


def _ordered(spans: Column) -> Column:
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
    back = F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"], s["start"], s["end"], s["value"]))
    return back.cast(NONE)


def _variety(value: Column) -> Column:
    return F.size(F.array_distinct(F.split(value, "")))


def candidates(text: Column) -> Column:
    """Runs of letters and digits that hold both and are long and varied."""
    pattern = rf"[A-Za-z0-9]{{{CANDIDATE_LEAST},}}"
    mixed = lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]") & (_variety(s["value"]) >= LEAST_VARIETY)
    clue = rf"[0-9][A-Za-z0-9]{{0,{CANDIDATE_LEAST}}}[A-Za-z]|[A-Za-z][A-Za-z0-9]{{0,{CANDIDATE_LEAST}}}[0-9]"
    return _only(text, clue, pattern, 3, mixed)


def text_of(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def _narrow(j: Column) -> Column:
    return (j["owners"] <= MOST_OWNERS) & (j["repositories"] <= MOST_REPOSITORIES) & (j["texts"] <= MOST_TEXTS)


def _copied(j: Column) -> Column:
    return (j["owners"] >= EXAMPLE_OWNERS) | (j["repositories"] >= EXAMPLE_REPOSITORIES) | (j["texts"] > MOST_TEXTS)


def scan(docs: DataFrame, repository: Column | None = None, owner: Column | None = None) -> DataFrame:
    """doc_id, key, base, spans (base and owned ones), spread, n_example, n_live per row.

    ``key`` tells rows apart by id and text; rows that are equal in both share it. ``spread`` holds the
    start, kind, owners, repositories and texts of every candidate's value. By default the
    repository is source and language, the owner is the source.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", "source", "lang") if repository is None else repository
    text = F.coalesce("text", F.lit(""))
    found = docs.select(
        "doc_id",
        key_of(docs).alias("key"),
        F.coalesce(repository.cast("string"), F.lit("")).alias("repository"),
        F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        base_spans(text).alias("base"),
        candidates(text).alias("free"),
    )
    found = staged(found, "spans")
    both = F.concat("base", "free")
    held = found.where(F.size("base") + F.size("free") > 0)
    each = held.select("key", "repository", "owner", "digest", F.explode(both).alias("s"))
    each = each.select("key", "repository", "owner", "digest", F.sha2("s.value", 256).alias("hash"), "s")
    spread = each.groupBy("hash").agg(
        F.count_distinct("owner").alias("owners"),
        F.count_distinct("owner", "repository").alias("repositories"),
        F.count_distinct("digest").alias("texts"),
    )
    judged = each.select("key", "hash", "s").distinct().join(spread, "hash")
    spans = judged.groupBy("key").agg(
        F.collect_list(F.struct("s", "owners", "repositories", "texts")).alias("judged")
    )  # the spans of one text
    owned = F.filter("judged", lambda j: (j["s"]["kind"] == 3) & _narrow(j))
    owned = F.transform(owned, lambda j: j["s"])
    free = F.filter(owned, lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    base_of = lambda test: F.size(F.filter("judged", lambda j: (j["s"]["kind"] < 3) & test(j)))
    joined = found.select("doc_id", "key", "base").join(spans, "key", "left")
    places = F.transform("judged", lambda j: F.struct(
        j["s"]["start"].alias("start"), j["s"]["kind"].alias("kind"), j["owners"], j["repositories"], j["texts"]
    ))
    return joined.select(
        "doc_id",
        "key",
        "base",
        F.coalesce(F.array_sort(places), F.array()).alias("spread"),
        F.when(F.col("judged").isNull(), F.col("base")).otherwise(_ordered(F.concat("base", free))).alias("spans"),
        F.when(F.col("judged").isNull(), 0).otherwise(base_of(_copied)).cast("long").alias("n_example"),
        F.when(F.col("judged").isNull(), 0).otherwise(base_of(_narrow)).cast("long").alias("n_live"),
    )


def key_of(docs: DataFrame) -> Column:
    """Tells rows apart by id and text."""
    return F.sha2(F.concat_ws("\x1f", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit(""))), 256)


def digests(scanned: DataFrame) -> DataFrame:
    """The contracted columns of a scan."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return scanned.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(text_of(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        text_of(F.col("spans")).alias("spans"),
        "n_example",
        "n_live",
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of every text replaced by ``mark``, n_chars anew; all rows stay.

    Spans that overlap are replaced together. Texts without spans do not move.
    """
    found = scan(docs).where(F.size("spans") > 0).dropDuplicates(["key"])
    places = F.transform("spans", lambda s: F.struct(s["start"], s["end"]))
    found = staged(found.select("key", places.alias("spans")), "found")
    if found.count() <= BROADCAST_TEXTS and (found.agg(F.max(F.size("spans"))).first()[0] or 0) <= BROADCAST_SPANS:
        found = F.broadcast(found)
    key, spans = (_new_name(docs, name) for name in ("key", "spans"))
    keyed = docs.withColumn(key, key_of(docs))
    joined = keyed.join(found.select(F.col("key").alias(key), F.col("spans").alias(spans)), key, "left")
    text = F.col("text")

    def step(state, s):
        gap = F.when(s["start"] >= state["at"], F.concat(F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit(mark))).otherwise("")
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], gap).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(spans, begin, step, lambda e: F.concat(e["out"], F.substring(text, e["at"] + 1, F.length(text))))
    new = joined.withColumn("text", F.when(F.col(spans).isNull(), text).otherwise(clean))
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return new.select(*[F.col(f"`{c}`") for c in docs.columns])


def _new_name(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores before it as keep it apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name
