"""Secret scans with an incremental blob ledger, in DataFrame operations only.

Every historical version of a path is content-addressed by the SHA-256 of its text,
its blob id. The ledger is a table that says which (blob, rule version) pairs have been
scanned and what they held; spans carry the id of the rule version that found them. A
run takes each blob once, leaves out the pairs in the ledger, scans the rest, adds them
to the ledger and joins what it holds back to all paths that ever held the blob. What
rule versions found that aren't asked for stays in the ledger and shows nowhere.

Positions come from the pieces between matches: ``split`` and ``regexp_extract_all``
walk the text alike, so a match starts at the summed lengths of what lies before. Each
is worked out once per text and rule, so time grows with the text and its matches.

A blob that many paths share is reduced before the shuffle (one row per blob and
task) and its findings are dealt to ``SALTS`` copies, so that its paths join in as
many tasks.

Edge cases: a null text is the empty blob; empty texts hold nothing; a very long text is
scanned whole, in one task; repeated rows give repeated rows; an empty table or ledger
gives an empty result; extra columns, also ones named like those made here, are ignored
(``redact`` gives them back unchanged).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..columns import fresh
from .common import whole_text

SALTS = 8
_CHUNK = 256


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds a match; it counts if its group ``group`` has ``least`` characters."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    #: A string that every match holds, where there is one: texts without it are not searched.
    needs: str = ""

    @property
    def id(self) -> str:
        return f"{self.kind}@{self.version}"


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(_any_case, ("password", "passwd", "secret", "token")), _any_case("api") + "_?" + _any_case("key")])
#: The base kinds, in their order. {32,} and {12,} find the same runs as + with a length test.
BASE_RULES = (
    Rule("assign", 1, rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=8),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}", needs="AKIA"),
    Rule("hex", 1, r"[0-9a-f]{32,}"),
)
#: Further kinds that this method adds.
MORE_RULES = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", needs="PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*", needs="eyJ"),
)
RULES = BASE_RULES + MORE_RULES
_PEM = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
#: What ``redact`` blanks: of a private key all up to its END line; where that is missing, the header lines and base64 lines that follow.
REDACT_RULES = tuple(
    Rule("pem", 2, rf"{_PEM}(?:[^-]*+(?:-(?!----)[^-]*+){{0,40}}-----END [A-Z ]*PRIVATE KEY-----|(?:\s*+[A-Z][A-Za-z-]*+:\x20[^\r\n]*+){{0,8}}(?:\s*+[A-Za-z0-9+/]++={{0,2}}(?=\s*(?:[\r\n]|\z)))*+)", needs="PRIVATE KEY-----") if r.kind == "pem" else r
    for r in RULES
)
#: A span: start, place of its kind among the rules, end.
_SPAN = "struct<s:bigint,k:int,e:bigint>"
LEDGER = "blob binary, rule_ids array<string>, spans array<struct<rule:string,s:bigint,e:bigint>>"


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _before(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array of counts the fold, from 0, of those before it.

    Two levels of ``_CHUNK`` keep the appending folds short in long arrays.
    """

    def running(array: Column, first: Column) -> Column:
        zero = F.struct(first.cast("long").alias("sum"), _empty("bigint").alias("out"))
        add = lambda acc, x: F.struct(step(acc["sum"], x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out"))
        return F.aggregate(array, zero, add, lambda acc: acc["out"])

    def chunked(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(v), F.lit(1)) - 1) / _CHUNK).cast("int")), lambda i: F.slice(v, i * _CHUNK + 1, _CHUNK))

    whole = lambda chunks: F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("long"), step))
    return _let(values, lambda v: _let(chunked(v), lambda chunks: F.flatten(F.zip_with(chunks, running(whole(chunks), F.lit(0)), running))))


def _add(a: Column, b: Column) -> Column:
    return a + b


def _spans(text: Column, rule: Rule, order: int, measure: Callable[[Column], Column]) -> Column:
    """Array of (s, k, e): start, order of the kind, end, as ``measure`` counts, of the rule's matches."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    size = lambda x: measure(x).cast("long")
    pieces = F.arrays_zip(F.transform(F.split(text, rule.pattern, -1), size).alias("gap"), F.transform(whole, size).alias("n"), F.transform(part, lambda x: F.length(x)).alias("g"))

    def place(own: Column) -> Column:  # the last gap has no match behind it
        starts = _before(F.transform(own, lambda z: z["gap"] + F.coalesce(z["n"], F.lit(0))), _add)
        placed = F.zip_with(own, starts, lambda z, at: F.struct((at + z["gap"]).alias("s"), F.lit(order).alias("k"), (at + z["gap"] + z["n"]).alias("e"), z["g"].alias("g")))
        return F.transform(F.filter(placed, lambda z: z["e"].isNotNull() & (z["g"] >= rule.least)), lambda z: F.struct(z["s"].alias("s"), z["k"].alias("k"), z["e"].alias("e")))

    return _let(pieces, place)


def _scan(text: Column, rule: Rule, order: int, measure: Callable[[Column], Column] = F.length) -> Column:
    """Spans of a rule, searched for only where the text can hold one."""
    can = F.contains(text, F.lit(rule.needs)) & F.regexp_like(text, F.lit(rule.pattern)) if rule.needs else F.regexp_like(text, F.lit(rule.pattern))
    return F.when(can, _spans(text, rule, order, measure)).otherwise(_empty(_SPAN))


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def scan_blobs(blobs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows (blob, rule_ids, spans) of the blobs that have pairs not yet in ``ledger``.

    ``blobs`` has blob and text, one row per blob. The new rows hold the newly
    scanned rules only; ``merge`` brings them together with what the ledger has.
    """
    ids = F.array(*[F.lit(r.id) for r in rules])
    if ledger is None:
        todo = blobs.select("blob", "text", ids.alias("todo"))
    else:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rule_ids"))).alias("seen"))
        todo = blobs.join(seen, "blob", "left").select("blob", "text", F.array_except(ids, F.coalesce("seen", _empty("string"))).alias("todo")).where(F.size("todo") > 0)
    wanted = (lambda r: F.lit(True)) if ledger is None else (lambda r: F.array_contains("todo", r.id))
    found = [F.when(wanted(r), _scan(F.col("text"), r, k)).otherwise(_empty(_SPAN)) for k, r in enumerate(rules)]
    named = F.transform(F.array_sort(F.concat(*found)), lambda z: F.struct(ids[z["k"]].alias("rule"), z["s"].alias("s"), z["e"].alias("e")))
    return todo.select("blob", F.col("todo").alias("rule_ids"), named.alias("spans"))


def merge(ledger: DataFrame | None, new: DataFrame) -> DataFrame:
    """One ledger row per blob: all rule versions it was scanned with, all their spans; a pair that was scanned twice counts once."""
    both = new if ledger is None else ledger.unionByName(new)
    return both.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rule_ids"))).alias("rule_ids"), F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))


def current(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, spans) of what ``rules`` found, spans as (s, k, e) in order."""
    ids = F.array(*[F.lit(r.id) for r in rules])
    own = F.filter("spans", lambda z: F.array_contains(ids, z["rule"]))
    return ledger.select("blob", F.array_sort(F.transform(own, lambda z: F.struct(z["s"].alias("s"), (F.array_position(ids, z["rule"]) - 1).cast("int").alias("k"), z["e"].alias("e")))).alias("spans"))


def read_ledger(spark, path: str) -> DataFrame | None:  # type: ignore[no-untyped-def]
    """The ledger kept at ``path``, one row per blob; None before the first run."""
    try:
        return merge(None, spark.read.schema(LEDGER).parquet(path))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def addressed(versions: DataFrame, path: str = "doc_id") -> DataFrame:
    return versions.select(F.col(path).alias("path"), whole_text().alias("text")).withColumn("blob", blob_id(F.col("text")))


def _joined(versions: DataFrame, known: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    held = current(known, rules).where(F.size("spans") > 0).select("blob", "spans", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    paths = versions.select("path", "blob", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int").alias("salt"))
    return paths.join(held, ["blob", "salt"], "left").select("path", "blob", F.coalesce("spans", _empty(_SPAN)).alias("spans"))


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, path: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(findings, new ledger rows): for every version its path, blob and spans; unseen pairs only are scanned."""
    own = addressed(versions, path)
    new = scan_blobs(own.groupBy("blob").agg(F.first("text").alias("text")), ledger, rules)
    return _joined(own, new if ledger is None else merge(ledger, new), rules), new


def scan_into(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, path: str = "doc_id") -> DataFrame:
    """The findings of ``versions``, by way of the ledger kept at ``ledger``.

    Unseen pairs are scanned and appended first; findings come from the ledger as it then
    stands. A run that fails leaves pairs unseen or whole rows, so it can be run again.
    """
    spark = versions.sparkSession
    own = addressed(versions, path)
    scan_blobs(own.groupBy("blob").agg(F.first("text").alias("text")), read_ledger(spark, ledger), rules).write.mode("append").parquet(ledger)
    return _joined(own, read_ledger(spark, ledger), rules)


def listed(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda z: F.concat_ws(":", F.element_at(kinds, z["k"] + 1), z["s"].cast("string"), z["e"].cast("string"))), ",")


def _of_kind(k: int) -> Column:
    return F.filter("spans", lambda z: z["k"] == k)


def digest(findings: DataFrame, path: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the SHA-256 of their list, and the list of all spans."""
    n = len(BASE_RULES)
    counts = [F.size(_of_kind(k)).cast("long").alias(f"n_{r.kind}") for k, r in enumerate(BASE_RULES)]
    base = F.filter("spans", lambda z: z["k"] < n)
    return findings.select(F.col("path").alias(path), *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = REDACT_RULES) -> DataFrame:
    """``docs`` with every secret replaced by ``[SECRET]``; n_chars follows. No document goes.

    Overlapping spans are merged first. Each distinct text is scanned once; texts
    without a finding pass untouched. Spans are counted in bytes here, so that a piece
    of a text is cut without walking all that lies before it.
    """
    blob, salt, found = fresh("blob", docs), fresh("salt", docs), fresh("found", docs)
    row = docs.withColumn(blob, blob_id(whole_text()))
    distinct = row.groupBy(F.col(blob).alias("blob")).agg(F.first(whole_text()).alias("text"))
    spans = F.array_sort(F.concat(*[_scan(F.col("text"), r, k, F.octet_length) for k, r in enumerate(rules)]))
    held = distinct.select("blob", spans.alias("spans")).where(F.size("spans") > 0).select(F.col("blob").alias(blob), F.col("spans").alias(found), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt))
    marked = row.withColumn(salt, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(held, [blob, salt], "left")

    def cleaned(raw: Column) -> Column:
        cut = lambda at, n: F.substring(raw, (at + 1).cast("int"), n.cast("int")).cast("string")

        def pieces(z: Column) -> Column:
            """What stands before each merged span, and behind the last."""
            ends = F.transform(z, lambda x: x["e"])
            reach = _before(ends, lambda a, b: F.greatest(a, b))
            opens = F.filter(F.zip_with(z, reach, lambda x, at: F.struct(x["s"].alias("s"), at.alias("at"))), lambda x: x["s"] >= x["at"])
            behind = _let(F.array_max(ends), lambda last: cut(last, F.octet_length("text") - last))
            return F.concat(F.transform(opens, lambda x: cut(x["at"], x["s"] - x["at"])), F.array(behind))

        return F.array_join(_let(F.col(found), pieces), "[SECRET]")

    clean = fresh("clean", marked)
    done = marked.withColumn(clean, F.when(F.col(found).isNotNull(), _let(F.col("text").cast("binary"), cleaned)).otherwise(F.col("text")))
    out = {c: F.col(f"`{c}`") for c in docs.columns} | {"text": F.col(clean)}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col(found).isNotNull(), F.length(clean).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return done.select(*[c.alias(name) for name, c in out.items()])
