"""The registered queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from . import chat, groups, langid, lloyd, media, mixing, pieces, quality, repeats, runs, secrets, shards, simhash, urls
from .common import WORD


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_progressive_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(media.store(_read(spark, sf_dir, "documents")))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Through a ledger of its own in the shared folder, which starts empty."""
    ledger = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    return secrets.digest(secrets.scan_into(_read(spark, sf_dir, "documents"), ledger))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = f"{chat.END}<|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return chat.format_digest(_read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)).drop("n_tokens", "loss_tokens")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_read(spark, sf_dir, "pages")).drop("n_candidates")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(_read(spark, sf_dir, "documents"), with_ids=True)


def op6_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_read(spark, sf_dir, "documents"), keep_text=False)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(_read(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = mixing.place(_read(spark, sf_dir, "documents"))
    return mixing.range_sorted(placed).select("doc_id", "size", "source_size", "target", "taken", "epochs", "position")


def op11_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.digest(lloyd.cluster(_read(spark, sf_dir, "embeddings")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    planted = docs.withColumn("text", runs.with_periodic_tail(F.col("text"), F.col("doc_id")))
    return runs.digest(runs.find_runs(planted))


def op13_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.digest(shards.sharded(_read(spark, sf_dir, "documents").select("doc_id", "text")))


def repeat_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maximal repeats of 50 bytes or more over all documents, each by its first occurrence."""
    return groups.first_occurrences(_read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)} | {"repeat_groups": repeat_groups}


_OP3_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|><|im_sep|><|im_end|>') + length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')))::BIGINT AS formatted_chars
FROM rows_ GROUP BY conv_id
"""


def _op4_sql() -> str:
    fits = []
    for rule in sorted(urls.SITE_RULES, key=lambda r: -len(r.text)):
        fits.append((f"(host = '{rule.host}' OR ends_with(host, '.{rule.host}')) AND starts_with(path, '{rule.path}')", rule))
    names = " OR ".join(f"list_contains(string_split(host, '.'), '{r.host}')" for r in urls.NAME_RULES)
    return f"""
WITH rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
split AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest)
SELECT page_id, host, path,
       CASE {" ".join(f"WHEN {c} THEN '{r.text}'" for c, r in fits)} END AS rule,
       CASE {" ".join(f"WHEN {c} THEN '{r.verdict}'" for c, r in fits)} WHEN {names} THEN 'block' ELSE 'allow' END AS verdict
FROM split
"""


def _op10_sql() -> str:
    case = lambda f: " ".join(f"WHEN rank % {len(mixing.SCHEDULES)} = {k} THEN {f(*s)}" for k, s in enumerate(mixing.SCHEDULES))

    def due(a: float, m: float, b: float) -> str:
        half, whole = (a + m) / 4, (a + 2 * m + b) / 4
        area = f"(middle / target * {whole!r}::DOUBLE)"
        first = f"2 * {area} / ({a!r}::DOUBLE + sqrt(greatest(0.0::DOUBLE, {a * a!r}::DOUBLE + {area} * {4 * (m - a)!r}::DOUBLE)))"
        second = f"0.5::DOUBLE + 2 * ({area} - {half!r}::DOUBLE) / ({m!r}::DOUBLE + sqrt(greatest(0.0::DOUBLE, {m * m!r}::DOUBLE + ({area} - {half!r}::DOUBLE) * {4 * (b - m)!r}::DOUBLE)))"
        return f"CASE WHEN {area} <= {half!r}::DOUBLE THEN {first} ELSE {second} END"

    weights = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(mixing.WEIGHTS))
    epochs = " + ".join(f"(CASE WHEN middle + {e} * source_size <= target THEN 1 ELSE 0 END)" for e in range(mixing.MAX_EPOCHS))
    return rf"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sized GROUP BY source),
w AS (SELECT *, CASE rank % {len(mixing.WEIGHTS)} {weights} END AS weight, {mixing.MAX_EPOCHS} * source_size AS cap FROM src),
f AS (SELECT *, cap::DOUBLE <= weight::DOUBLE * (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS is_full
      FROM w WINDOW b AS (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, CASE WHEN is_full THEN cap::DOUBLE ELSE weight * ((sum(source_size) OVER () - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ())::DOUBLE
      / nullif(sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER (), 0)::DOUBLE) END AS target FROM f),
run AS (SELECT s.doc_id, s.size, t.source_size, t.target, t.rank,
        coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(s.doc_id::VARCHAR), s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE + s.size / 2.0::DOUBLE AS middle
        FROM sized s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN size > 0 THEN {epochs} ELSE 0 END::BIGINT AS epochs FROM run)
SELECT doc_id, size, source_size, target, epochs * size AS taken, epochs, CASE WHEN epochs > 0 THEN round(CASE {case(due)} END, 9) END AS position FROM e
"""


#: Windows as hex strings, cut from pieces of 512 so that no long text is walked once per window.
_OP6_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(doc_id, 9223372036854775807) AS id, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT rid, id, j, substr(h, 1024 * j + 1, 1122) AS piece, least(512, length(h) // 2 - 49 - 512 * j) AS k FROM (SELECT *, unnest(range(0, greatest(0, (length(h) // 2 + 462) // 512))) AS j FROM d)),
w AS (SELECT rid, id, 512 * j + i AS pos, substr(piece, 2 * i + 1, 100) AS s FROM (SELECT *, unnest(range(0, k)) AS i FROM p)),
m AS (SELECT s, min(id) AS first_id FROM w GROUP BY s HAVING count(*) > 1),
r AS (SELECT rid, pos, lag(pos) OVER (PARTITION BY rid ORDER BY pos) AS before FROM w JOIN m USING (s) WHERE first_id < id),
g AS (SELECT rid, pos, sum(CASE WHEN before IS NULL OR pos - before > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY pos) AS run FROM r),
spans AS (SELECT rid, run, min(pos) AS a, max(pos) + 50 AS b FROM g GROUP BY rid, run),
gaps AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS c FROM spans),
kept AS (SELECT d.rid, count(a) AS n_spans, coalesce(sum(b - a), 0)::BIGINT AS n_removed,
                coalesce(string_agg(substr(h, 2 * c + 1, 2 * (a - c)), '' ORDER BY a), '') || substr(any_value(h), 2 * coalesce(max(b), 0) + 1) AS rest FROM d LEFT JOIN gaps USING (rid) GROUP BY d.rid)
SELECT doc_id, length(h) // 2 AS n_bytes, n_removed, n_spans, sha256(unhex(rest)) AS kept_sha256 FROM d JOIN kept USING (rid)
"""


def _op2_sql() -> str:
    def spans(k: int, rule: secrets.Rule) -> str:
        pattern = rule.pattern.replace("'", "''")
        return f"""
  SELECT doc_id, {k} AS k, '{rule.kind}' AS kind, unnest(regexp_extract_all(text, '{pattern}', 0)) AS m, unnest(regexp_extract_all(text, '{pattern}', {rule.group})) AS part,
         unnest(string_split_regex(text, '{pattern}')) AS gap, unnest(range(1, len(string_split_regex(text, '{pattern}')) + 1)) AS i
  FROM docs WHERE regexp_matches(text, '{pattern}')"""

    least = " ".join(f"WHEN {k} THEN {r.least}" for k, r in enumerate(secrets.RULES))
    base = len(secrets.BASE_RULES)
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(spans(k, r) for k, r in enumerate(secrets.RULES))}),
placed AS (SELECT *, sum(length(gap)) OVER w + coalesce(sum(length(m)) OVER b, 0) AS s FROM found
           WINDOW w AS (PARTITION BY doc_id, k ORDER BY i), b AS (PARTITION BY doc_id, k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
spans AS (SELECT doc_id, k, kind, s::BIGINT AS s, (s + length(m))::BIGINT AS e FROM placed WHERE m IS NOT NULL AND length(part) >= CASE k {least} END),
per AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
               string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < {base}) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(p.spans, '') AS spans FROM docs d LEFT JOIN per p USING (doc_id)
"""


def _op11_sql(k: int = 8, rounds: int = 10) -> str:
    """All rounds unrolled: ``a`` has each vector's owner, ``c`` the centroids."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT rid, vec_id, v, arg_min(c, d * {k} + c) AS c, min(d) AS d FROM
  (SELECT rid, vec_id, kept.v, c.c, list_sum(list_transform(list_zip(kept.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM kept, c{r} c) GROUP BY ALL)""")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS i FROM a{r}) GROUP BY c, i),
c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{r} GROUP BY c) m USING (c))""")
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, v) - 1 AS c, v FROM kept QUALIFY c < {k}),
{", ".join(steps)}
SELECT a.vec_id, a.c::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c USING (c)
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_delta_lloyd": _op11_sql(), "op2_secret_scans": _op2_sql(), "op6_suffix_repeats": _OP6_SQL, "op3_chat_formatting": _OP3_SQL, "op4_url_filters": _op4_sql(), "op10_mixing": _op10_sql()}
