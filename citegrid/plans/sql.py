"""The catalog's queries in DuckDB SQL: common table expressions and one statement for each key."""

from __future__ import annotations

from citegrid.operators import filters, indices, stats

METRICS = list(indices.METRICS)
FEW = ["p", "c", "c_frac", "h", "g", "i10", "islv", "iupv_s"]


def r(*names: str, digits: int = 6) -> str:
    """Rounded columns; adding 0 makes a negative zero positive."""
    return ", ".join(f"round({n}, {digits}) + 0 AS {n.split('.')[-1]}" for n in names)


WORKS = """
ac AS (SELECT l_orderkey AS k, count(*) AS raw, count(DISTINCT CASE WHEN l_partkey % 97 <> 0 AND l_partkey % 211 <> 0 THEN l_partkey END) AS valid FROM lineitem GROUP BY 1),
wk AS (SELECT o.*, c_mktsegment, n_name, r_regionkey, r_name, coalesce(raw, 0) AS raw, coalesce(valid, 0) AS valid,
  coalesce(raw + CASE WHEN o_orderkey % 40 = 3 THEN 2 WHEN o_orderkey % 60 = 4 THEN 1 ELSE 0 END, 0) AS reported
  FROM orders o JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN ac ON k = o_orderkey),
works AS (SELECT 'https://example.org/W' || o_orderkey AS work_id, CASE WHEN o_orderkey % 2 = 0 THEN 'https://doi.org/10.1/' ELSE '10.1/' END || o_orderkey AS doi,
  'Work ' || o_orderkey || ' ' || c_mktsegment || ' ' || n_name AS display_name, CAST(year(o_orderdate) AS INTEGER) AS publication_year, strftime(o_orderdate, '%Y-%m-%d') AS publication_date,
  CASE o_orderstatus WHEN 'F' THEN 'article' WHEN 'O' THEN 'review' ELSE 'preprint' END AS type, 'l' || r_regionkey AS language,
  CAST(greatest(0, floor(o_totalprice / 4000) - 25) AS BIGINT) AS cited_by_count, o_orderkey % 2 = 0 AS open_access_is_oa, o_orderkey % 3 <> 0 AS has_abstract,
  o_orderkey % 50 = 0 AS is_retracted, o_orderkey % 75 = 1 AS is_paratext, o_orderkey % 90 = 2 AS is_xpac, o_orderkey % 40 = 3 AS is_authors_truncated,
  CAST(reported AS BIGINT) AS authors_count_reported, CAST(raw AS BIGINT) AS authorships_count_raw, CAST(valid AS BIGINT) AS valid_author_ids_count,
  CASE WHEN o_orderkey % 100 <> 5 THEN 'https://example.org/T' || substr(o_orderpriority, 1, 1) END AS primary_topic_id, CASE WHEN o_orderkey % 100 <> 5 THEN o_orderpriority END AS primary_topic_display_name,
  'https://example.org/subfields/' || c_mktsegment AS primary_subfield_id, c_mktsegment AS primary_subfield_short_id, 'https://example.org/fields/' || r_name AS primary_field_id,
  'https://example.org/domains/1' AS primary_domain_id, 'S' || n_name AS source_id, n_name AS source_display_name, 'journal' AS source_type FROM wk)"""

PEOPLE = """
au0 AS (SELECT l.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS author_seq,
  CASE WHEN l_partkey % 97 = 0 THEN 'A9999999999' WHEN l_partkey % 211 = 0 THEN 'A5317838346' ELSE 'A' || l_partkey END AS author_id FROM lineitem l),
authorships AS (SELECT 'https://example.org/W' || l_orderkey AS work_id, author_seq, CASE WHEN author_seq = 1 THEN 'first' WHEN author_seq = raw THEN 'last' ELSE 'middle' END AS author_position, author_id,
  p_name || ' ' || p_partkey AS author_display_name, CASE WHEN l_partkey % 3 = 0 THEN 'https://orcid.org/' || l_partkey END AS author_orcid, author_seq = 1 AS is_corresponding,
  'I' || l_suppkey AS institution_ids_csv, 'N' || chr(65 + s_nationkey) AS country_codes_csv, raw AS authorships_count_raw,
  raw + CASE WHEN l_orderkey % 40 = 3 THEN 2 WHEN l_orderkey % 60 = 4 THEN 1 ELSE 0 END AS authors_count_reported, valid AS valid_author_ids_count,
  author_id = 'A9999999999' AS qf_null_author_id, author_id = 'A5317838346' AS qf_deleted_author_id, count(*) OVER (PARTITION BY l_orderkey, author_id) > 1 AS qf_duplicate_authorship,
  l_orderkey % 40 = 3 AS qf_authorship_truncated, l_orderkey % 40 = 3 OR l_orderkey % 60 = 4 AS qf_author_count_mismatch, l_orderkey % 100 = 5 AS qf_missing_primary_topic
  FROM au0 JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN ac ON k = l_orderkey)"""

TOPICS = """
work_topics AS (SELECT work_id, primary_topic_id AS topic_id, primary_topic_display_name AS topic_display_name, 0.9::DOUBLE AS score, primary_subfield_id AS subfield_id, primary_field_id AS field_id, primary_domain_id AS domain_id, true AS is_primary FROM works WHERE primary_topic_id IS NOT NULL
  UNION ALL SELECT work_id, 'https://example.org/S' || CAST(split_part(work_id, 'W', 2) AS BIGINT) % 7, 'S' || CAST(split_part(work_id, 'W', 2) AS BIGINT) % 7, 0.5::DOUBLE, primary_subfield_id, primary_field_id, primary_domain_id, false FROM works)"""

GUARD = "NOT is_retracted AND NOT is_paratext AND NOT is_xpac"
CREDIT = f"""
b0 AS (SELECT a.*, publication_year, cited_by_count, row_number() OVER (PARTITION BY a.work_id, author_id ORDER BY author_seq, author_display_name) AS rn
  FROM authorships a JOIN (SELECT work_id, publication_year, cited_by_count FROM works WHERE {GUARD}) w ON a.work_id = w.work_id WHERE author_id NOT IN ('A9999999999', 'A5317838346')),
b1 AS (SELECT *, CAST(authors_count_reported AS DOUBLE) AS reported, CAST(valid_author_ids_count AS DOUBLE) AS validn, unnest(['strict_authors_count', 'renorm_valid_authors', 'integer']) AS fraction_mode FROM b0 WHERE rn = 1),
b2 AS (SELECT *, CASE fraction_mode WHEN 'strict_authors_count' THEN reported WHEN 'renorm_valid_authors' THEN validn ELSE 1.0 END AS used, CASE WHEN fraction_mode = 'strict_authors_count' THEN greatest(0.0, 1.0 - validn / reported) END AS om FROM b1),
author_work AS (SELECT 'base' AS run_id, fraction_mode, work_id, author_id, author_display_name, publication_year, cited_by_count, CAST(used AS DOUBLE) AS authors_count_used, reported AS actual_authors_count, reported AS authors_count_reported,
  CAST(1.0 / used AS DOUBLE) AS credit_weight, CAST(cited_by_count * (1.0 / used) AS DOUBLE) AS cited_credit, reported = 1 AS single_authored_flag,
  qf_null_author_id OR qf_deleted_author_id OR qf_duplicate_authorship OR qf_authorship_truncated OR qf_author_count_mismatch OR qf_missing_primary_topic AS qf_any,
  qf_authorship_truncated OR reported > authorships_count_raw AS qf_authorship_truncated, fraction_mode = 'strict_authors_count' AND (coalesce(om, 0) > 0 OR qf_author_count_mismatch) AS qf_author_omission, CAST(om AS DOUBLE) AS omitted_author_fraction FROM b2 WHERE used > 0)"""


def index_ctes(source: str = "author_work", name: str = "ix") -> str:
    """Indices of a credit table; ``name`` is the last expression's."""
    pr = ""
    for i, m in enumerate(("p", "h", "c_frac", "g", "i10", "rfi_log_frac")):
        of = f"{name}b" if i == 0 else f"{name}p{i - 1}"
        pr += f"""
{name}p{i} AS (SELECT x.*, CASE WHEN {m} > 0 THEN greatest(1e-6, (rank() OVER (PARTITION BY run_id, fraction_mode, {m} > 0 ORDER BY round({m}, 9)) + (count(*) OVER (PARTITION BY run_id, fraction_mode, round({m}, 9)) - 1) / 2.0) / count(*) OVER (PARTITION BY run_id, fraction_mode, {m} > 0)) ELSE 0.0 END AS pr_{m} FROM {of} x),"""
    weights = " + ".join(f"{w}::DOUBLE * ln(least(1.0, greatest(0.0, pr_{m}) + 0.01)::DOUBLE)" for m, w in indices.ISLV_WEIGHTS.items())
    return f"""
{name}a AS (SELECT *, row_number() OVER w AS rk, sum(greatest(cited_by_count, 0)) OVER (w ROWS UNBOUNDED PRECEDING) AS cum FROM {source} WINDOW w AS (PARTITION BY run_id, fraction_mode, author_id ORDER BY greatest(cited_by_count, 0) DESC, work_id)),
{name}b AS (SELECT run_id, fraction_mode, author_id, arg_min(author_display_name, work_id) AS author_display_name, count(DISTINCT work_id) AS p, CAST(sum(cited_by_count) AS DOUBLE) AS c, sum(cited_credit) AS c_frac,
  sum(cited_by_count)::DOUBLE / count(DISTINCT work_id) AS cpp, coalesce(max(CASE WHEN cited_by_count >= rk THEN rk END), 0) AS h, count(*) FILTER (cited_by_count >= 10) AS i10, coalesce(max(CASE WHEN cum >= rk * rk THEN rk END), 0) AS g,
  coalesce(max(CASE WHEN cited_by_count >= rk THEN rk END), 0)::DOUBLE / greatest(1, max(publication_year) - min(publication_year) + 1) AS m_local,
  CASE WHEN sum(cited_by_count) > 0 THEN max(cited_by_count)::DOUBLE / sum(cited_by_count)::DOUBLE ELSE 0.0::DOUBLE END AS top1_share, sum(ln(1 + greatest(0, cited_credit)::DOUBLE)) AS rfi_log_frac,
  CAST(count(*) FILTER (cited_by_count >= 5) AS DOUBLE) AS n_cited5, coalesce(sum(credit_weight) FILTER (cited_by_count >= 5), 0.0::DOUBLE) AS frac_cited5,
  count(DISTINCT work_id) / (count(DISTINCT work_id) + 5.0::DOUBLE) * sum(ln(1 + cited_by_count::DOUBLE) / greatest(1.0, authors_count_used) * exp(-0.15::DOUBLE * greatest(0, 2026 - publication_year))) AS lrdi,
  avg(greatest(1.0::DOUBLE, actual_authors_count)) AS mean_authors_per_work, avg(CASE WHEN single_authored_flag THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS share_single_authored,
  count(*) FILTER (qf_any) AS n_flagged_works, count(*) FILTER (qf_authorship_truncated) AS n_truncated_works FROM {name}a GROUP BY 1, 2, 3),{pr}
{name} AS (SELECT * EXCLUDE (pr_p, pr_h, pr_c_frac, pr_g, pr_i10, pr_rfi_log_frac), CASE WHEN p > 0 AND h > 0 AND c_frac > 0 THEN 100 * pow((pr_p * pr_h * pr_c_frac)::DOUBLE, 1.0::DOUBLE / 3) ELSE 0.0::DOUBLE END AS pci,
  CASE WHEN rfi_log_frac > 0 THEN (100 * pr_rfi_log_frac)::DOUBLE ELSE 0.0::DOUBLE END AS iupv_s, CASE WHEN rfi_log_frac > 0 THEN 100 * sqrt((pr_p * pr_rfi_log_frac)::DOUBLE) ELSE 0.0::DOUBLE END AS iupv_sb,
  100 * exp({weights}) * greatest(0.0, least(1.0, 1 - 0.3::DOUBLE * greatest(0.0, least(1.0, top1_share) - 0.5::DOUBLE))) AS islv FROM {name}p5)"""


BASE = f"WITH {WORKS},{PEOPLE}"
CREDITED = f"{BASE},{CREDIT}"
INDEXED = f"{CREDITED},{index_ctes()}"
DOUBLES = ["c", "c_frac", "cpp", "m_local", "top1_share", "rfi_log_frac", "n_cited5", "frac_cited5", "pci", "iupv_s", "iupv_sb", "islv", "lrdi", "mean_authors_per_work", "share_single_authored"]
WHOLE = ["p", "h", "i10", "g", "n_flagged_works", "n_truncated_works"]
INDEX_COLUMNS = f"run_id, fraction_mode, author_id, author_display_name, {', '.join(WHOLE)}, {r(*DOUBLES)}"
#: The selection of the statistics queries: strict mode, to nine decimals, so that sums in another order don't break ties.
STRICT = f"{INDEXED}, s AS (SELECT * REPLACE ({r(*DOUBLES, digits=9)}) FROM ix WHERE fraction_mode = 'strict_authors_count')"


def long(metrics: list[str] = FEW, source: str = "s") -> str:
    return "lg AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, author_id, CAST({m} AS DOUBLE) AS value FROM {source}" for m in metrics) + ")"


LONG = f"{STRICT}, {long()}"
RANKED = f"{LONG}, rk AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY value DESC) AS rank FROM lg)"
FENCES = """f AS (SELECT metric, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3, min(value) AS lo, max(value) AS hi FROM lg GROUP BY metric),
fe AS (SELECT *, q3 - q1 AS iqr, CASE WHEN q3 > q1 THEN q1 - 1.5 * (q3 - q1) END AS lower_fence, CASE WHEN q3 > q1 THEN q3 + 1.5 * (q3 - q1) END AS upper_fence FROM f)"""
AVG_RANKS = "ar AS (SELECT metric, author_id, value, rank() OVER (PARTITION BY metric ORDER BY value) + (count(*) OVER (PARTITION BY metric, value) - 1) / 2.0 AS avg_rank FROM lg)"
DELTAS = "d AS (SELECT a.metric, a.author_id, b.rank AS baseline_rank, a.rank AS metric_rank, a.rank - b.rank AS rank_delta, abs(a.rank - b.rank) AS abs_rank_delta FROM rk a JOIN rk b ON a.author_id = b.author_id AND b.metric = 'h' WHERE a.metric <> 'h')"
POPMOMENTS = "avg(value) AS mean, stddev_pop(value) AS stddev"


def moments(v: str) -> str:
    """Population skewness and excess kurtosis of a column, null without variance."""
    return f"""mo AS (SELECT metric, count(value) AS n, avg({v}) AS m1, stddev_pop({v}) AS sd FROM lg GROUP BY metric),
mm AS (SELECT metric, max(n) AS n, max(sd) AS sd, CASE WHEN max(sd) > 0 THEN avg(pow({v} - m1, 3)) / pow(max(sd), 3) END AS skewness, CASE WHEN max(sd) > 0 THEN avg(pow({v} - m1, 4)) / pow(max(sd), 4) - 3 END AS excess_kurtosis FROM lg JOIN mo USING (metric) GROUP BY metric)"""


def corr(x: str, y: str) -> str:
    return f"CASE WHEN stddev_pop({x}) > 0 AND stddev_pop({y}) > 0 THEN corr({x}, {y}) END"


PAIRS = [(a, b) for i, a in enumerate(FEW) for b in FEW[i + 1 :]]


def _histogram(v: str, bins: int = 12, sparse: bool = False, rows: str = "", edge: int | None = None) -> str:
    where = " WHERE count > 0" if sparse else ""
    place = f"({v} - lo) / width" if edge is None else f"round(({v} - lo) / width, {edge})"
    digits = "printf('%.3g', lo + ev.bin * width)"
    upper = f"printf('%.3g', CASE WHEN ev.bin = {bins - 1} THEN hi ELSE lo + (ev.bin + 1) * width END)"
    label = f", CASE WHEN lo = hi THEN {digits} ELSE {digits} || '-' || {upper} END AS label" if sparse else ""
    return f"""{rows or LONG}, bo AS (SELECT metric, min({v}) AS lo, max({v}) AS hi, (max({v}) - min({v})) / {bins} AS width FROM lg GROUP BY metric),
hb AS (SELECT lg.metric, CASE WHEN width = 0 THEN 0 ELSE CAST(least({bins - 1}, floor({place})) AS BIGINT) END AS bin, count(*) AS count FROM lg JOIN bo USING (metric) GROUP BY 1, 2),
ev AS (SELECT *, unnest(range(0, CASE WHEN lo = hi THEN 1 ELSE {bins} END)) AS bin FROM bo),
o AS (SELECT ev.metric, ev.bin, round(lo + ev.bin * width, 6) AS low, round(CASE WHEN ev.bin = CASE WHEN lo = hi THEN 0 ELSE {bins - 1} END THEN hi ELSE lo + (ev.bin + 1) * width END, 6) AS high, coalesce(count, 0) AS count{label} FROM ev LEFT JOIN hb ON ev.metric = hb.metric AND ev.bin = hb.bin)
SELECT * FROM o{where}"""


def _box(view: str) -> str:
    cut = {"all": "true", "nonzero": "value <> 0", "central95": "value BETWEEN a AND b"}[view]
    return f"""{STRICT}, {long().replace("lg AS", "l0 AS")}, cc AS (SELECT metric, quantile_cont(value, 0.025) AS a, quantile_cont(value, 0.975) AS b FROM l0 GROUP BY metric),
lg AS (SELECT metric, author_id, value FROM l0 JOIN cc USING (metric) WHERE {cut}), {FENCES}
SELECT metric, count(*) AS n, {r("max(q1)").replace("AS max(q1)", "AS q1")}, round(max(median), 6) AS median, round(max(q3), 6) AS q3, round(max(iqr), 6) AS iqr, round(max(lower_fence), 6) AS lower_fence, round(max(upper_fence), 6) AS upper_fence,
round(CASE WHEN max(iqr) = 0 THEN max(q1) ELSE min(value) FILTER (value BETWEEN coalesce(lower_fence, value) AND coalesce(upper_fence, value)) END, 6) AS whisker_low,
round(CASE WHEN max(iqr) = 0 THEN max(q3) ELSE max(value) FILTER (value BETWEEN coalesce(lower_fence, value) AND coalesce(upper_fence, value)) END, 6) AS whisker_high,
count(*) FILTER (iqr > 0 AND (value < lower_fence OR value > upper_fence)) AS n_outliers, count(*) FILTER (iqr = 0 AND value <> median) AS n_display_outliers,
max(CASE WHEN iqr = 0 THEN 'iqr_zero_no_outlier_fence' ELSE 'iqr_1_5' END) AS outlier_rule FROM lg JOIN fe USING (metric) GROUP BY metric"""


def _filtered(where: str, people: str = "true", topics: str = "") -> str:
    """Indices of a filtered slice: works, people."""
    return f"""{CREDITED},{TOPICS}, fw AS (SELECT * FROM works WHERE {where}), fp AS (SELECT DISTINCT work_id, author_id FROM authorships WHERE {people}),
fa AS (SELECT * FROM author_work WHERE fraction_mode = 'strict_authors_count' AND work_id IN (SELECT work_id FROM fw) AND (work_id, author_id) IN (SELECT (work_id, author_id) FROM fp)),{index_ctes("fa", "fx")}"""


def _topics_match(text: str) -> str:
    return " OR ".join(f"coalesce({c} ILIKE '%{text}%', false)" for c in ("display_name", "source_display_name", "primary_topic_display_name", "doi"))


def _group(metric: str) -> str:
    kinds = {"core": stats.CORE, "diagnostic": stats.DIAGNOSTIC, "experimental": stats.EXPERIMENTAL}
    return "CASE " + " ".join(f"WHEN {metric} IN ({', '.join(repr(m) for m in of)}) THEN '{kind}'" for kind, of in kinds.items()) + " ELSE 'custom' END"


WORK_COLUMNS = sorted(
    ["work_id", "doi", "display_name", "publication_year", "publication_date", "type", "language", "cited_by_count", "open_access_is_oa", "has_abstract", "is_retracted", "is_paratext", "is_xpac", "is_authors_truncated"]
    + ["authors_count_reported", "authorships_count_raw", "valid_author_ids_count", "primary_topic_id", "primary_topic_display_name", "primary_subfield_id", "primary_subfield_short_id", "primary_field_id", "primary_domain_id"]
    + ["source_id", "source_display_name", "source_type"]
)
SQL: dict[str, str] = {
    "j1_works_authorships": f"{BASE} SELECT type, count(*) AS authorships, count(DISTINCT author_id) AS authors, CAST(sum(cited_by_count) AS BIGINT) AS citations FROM authorships JOIN works USING (work_id) GROUP BY type",
    "aw1_author_work": f"{CREDITED} SELECT * EXCLUDE (credit_weight, cited_credit, omitted_author_fraction), {r('credit_weight', 'cited_credit', 'omitted_author_fraction')} FROM author_work",
    "ix19_indices": f"{INDEXED} SELECT {INDEX_COLUMNS} FROM ix",
    "ix20_filtered_indices": f"""{_filtered("publication_date >= '1997-01-01' AND type IN ('article', 'review')", people="'NA' = country_codes_csv")},
pl AS (SELECT fa.author_id, fa.work_id, cc, primary_topic_display_name AS sn FROM fa JOIN (SELECT work_id, author_id, string_agg(DISTINCT country_codes_csv, '|' ORDER BY country_codes_csv) AS cc FROM authorships GROUP BY 1, 2) USING (work_id, author_id) JOIN works USING (work_id)),
pf AS (SELECT author_id, arg_min(cc, work_id) FILTER (cc <> '') AS country_code, arg_min(sn, work_id) FILTER (sn <> '') AS subject_name FROM pl GROUP BY 1)
SELECT author_id, {', '.join(WHOLE)}, {r(*DOUBLES)}, country_code, subject_name, 'filtered_recomputed' AS metric_scope, 'current filtered author set' AS percentile_scope FROM fx LEFT JOIN pf USING (author_id)""",
    "ix23_selected_indices": f"{INDEXED} SELECT author_id, {', '.join(WHOLE)}, {r(*DOUBLES)} FROM ix WHERE fraction_mode = 'strict_authors_count' AND author_id IN (SELECT author_id FROM authorships WHERE country_codes_csv = 'NB')",
    "rk5_ascending_rows": f"{STRICT}, q AS (SELECT *, rank() OVER (ORDER BY g) AS rank_competition FROM s) SELECT author_id, author_display_name, CAST(g AS DOUBLE) AS score, p, round(c, 6) AS c, rank_competition FROM q ORDER BY g, c, p, author_id DESC LIMIT 60",
    "rk7_bundle": f"{STRICT} SELECT author_id, author_display_name, CAST(g AS DOUBLE) AS score, row_number() OVER (ORDER BY g DESC, c DESC, p DESC, author_display_name, author_id) AS rank_ordinal, rank() OVER (ORDER BY g DESC) AS rank_competition, dense_rank() OVER (ORDER BY g DESC) AS rank_dense, count(*) OVER () AS total FROM s ORDER BY rank_ordinal LIMIT 15",
    "sl5_subject": f"WITH {WORKS} SELECT work_id FROM works WHERE (primary_subfield_short_id = 'BUILDING' OR primary_subfield_id ILIKE '%/BUILDING') AND publication_date <= '1997-06-30' AND has_abstract",
    "sl13_text_in_slice": f"""{CREDITED},{TOPICS}, fw AS (SELECT * FROM works WHERE language = 'l2' AND (work_id IN (SELECT work_id FROM work_topics WHERE topic_id ILIKE '%urgent%' OR topic_display_name ILIKE '%urgent%') OR {_topics_match('urgent')}))
SELECT fraction_mode, count(*) AS rows, count(DISTINCT author_id) AS authors, CAST(sum(a.cited_by_count) AS BIGINT) AS citations FROM author_work a JOIN fw USING (work_id)
WHERE author_display_name ILIKE '%nation_1%' OR display_name ILIKE '%nation_1%' OR source_display_name ILIKE '%nation_1%' OR primary_topic_display_name ILIKE '%nation_1%' GROUP BY fraction_mode""",
    "sl14_clean_country": f"{BASE} SELECT work_id, author_seq FROM authorships WHERE country_codes_csv = 'NB'",
    "p3_joined_filter": f"{BASE} SELECT a.work_id, a.author_seq FROM works w JOIN authorships a USING (work_id) WHERE a.author_display_name ILIKE '%small%' AND w.cited_by_count BETWEEN 10 AND 30 AND w.display_name ILIKE '%machinery%'",
    "p4_search": f"WITH {WORKS} SELECT work_id FROM works WHERE display_name ILIKE '%nation_2%' OR doi ILIKE '%nation_2%' OR work_id ILIKE '%nation_2%' OR source_display_name ILIKE '%nation_2%' OR coalesce(primary_topic_display_name, '') ILIKE '%nation_2%'",
    "p9_columns": f"{STRICT} SELECT author_id, round(c_frac, 6) AS c_frac, h FROM s ORDER BY s.c_frac, c DESC, p DESC, author_display_name, author_id LIMIT 30",
    "p11_only_authors": f"{STRICT} SELECT author_id, p FROM s WHERE author_id IN (SELECT author_id FROM authorships WHERE country_codes_csv = 'NB')",
    "p18_alias_search": "SELECT p_partkey AS position, p_name AS label FROM part WHERE lower(concat_ws(' ', CAST(p_partkey AS VARCHAR), p_name, p_brand, p_type)) LIKE '%small%' ORDER BY position LIMIT 12",
    "ch5_resolved_cohort": f"{STRICT}, {_filtered("publication_date >= '1995-01-01' AND type = 'article'")[_filtered('true').index(' fw AS'):]} SELECT author_id, p, h, round(c, 6) AS c, 'membership_filters' AS resolved_filter_mode FROM fx WHERE author_id IN (SELECT author_id FROM s WHERE p >= 25)",
    "ch8_decision_trace": f"{STRICT}, t AS (SELECT author_id, p, h FROM s ORDER BY h DESC, c DESC, p DESC, author_display_name, author_id LIMIT 25), x AS (SELECT count(*) AS n_rows, CAST(sum(CAST('0x' || substr(md5(concat_ws('|', author_id, h, p)), 1, 15) AS HUGEINT)) AS VARCHAR) AS rows FROM t) SELECT n_rows, sha256('metric=h' || chr(10) || 'n=25' || chr(10) || n_rows || chr(10) || rows) AS trace FROM x",
    "io1_json_lines": "SELECT o_orderkey, o_orderstatus FROM orders",
    "io5_either_table": "SELECT c_custkey, c_name FROM customer",
    "io7_csv_numbers": "SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber, format('{:.10g}', CAST(l_extendedprice AS DOUBLE) / 7 * pow(10.0::DOUBLE, l_linenumber * 4 - 14)) AS x, CASE WHEN l_linenumber = 1 THEN 'true' ELSE 'false' END AS first FROM lineitem",
    "io9_registered": f"WITH {WORKS} SELECT type, count(*) AS n FROM works GROUP BY type",
    "io11_fingerprint": f"WITH {WORKS} SELECT count(*) AS rows, CAST(sum(CAST('0x' || substr(md5(concat_ws('|', {', '.join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in WORK_COLUMNS)})), 1, 15) AS HUGEINT)) AS VARCHAR) AS hash_sum FROM works",
    "ud5_template": f"{STRICT} SELECT author_id, round(2.0::DOUBLE * h + 0.5::DOUBLE * sqrt(c_frac), 6) AS custom_tpl FROM s",
    "ud6_validate_formula": f"""{STRICT}, z AS (SELECT *, sqrt(c) + h AS v FROM s), k AS (SELECT *, {', '.join(f'row_number() OVER (ORDER BY {m} DESC, c DESC, p DESC, author_id) AS r_{m}' for m in ('v', 'p', 'c', 'c_frac', 'h', 'g', 'i10'))} FROM z),
e AS (SELECT count(*) AS n, 1 - count(DISTINCT round(v, 12)) / count(*)::DOUBLE AS tie_rate, corr(v, mean_authors_per_work) AS co FROM z)
""" + " UNION ALL ".join(f"SELECT 'custom_v' AS metric, '{m}' AS compared_with, n AS n_authors, round(rho, 6) AS spearman, top AS top_overlap, round(top / least(20, n)::DOUBLE, 6) AS top_overlap_rate, round(tie_rate, 6) AS tie_rate, round(co, 6) AS coauthorship_score_correlation, CASE WHEN tie_rate > 0.5 THEN 'high_tie_rate' WHEN rho > 0.98 THEN 'duplicates_core_metric' END AS warning FROM e, (SELECT corr(r_v, r_{m}) AS rho, count(*) FILTER (r_v <= 20 AND r_{m} <= 20) AS top FROM k)" for m in ("p", "c", "c_frac", "h", "g", "i10")),
    "ud7_saved_formulas": "WITH c AS (SELECT c_mktsegment AS run_id, 'm' || c_custkey % 50 AS metric_id, 'h + ' || c_custkey AS expression, c_custkey % 3 <> 0 AS enabled, c_custkey AS k FROM customer), g AS (SELECT metric_id, arg_max(expression, k) AS expression, arg_max(enabled, k) AS enabled, min(k) AS created_at, max(k) AS updated_at FROM c WHERE run_id = 'BUILDING' AND metric_id <> 'm7' GROUP BY 1) SELECT metric_id, expression, created_at, updated_at FROM g WHERE enabled",
    "sl18_calibration": "WITH r AS (SELECT o_orderkey AS run, o_orderdate AS finished_at, o_totalprice::DOUBLE AS actual, (o_totalprice / (1 + o_orderkey % 3))::DOUBLE AS estimated FROM orders), l AS (SELECT actual / estimated AS q FROM r WHERE estimated > 0 AND actual > 0 ORDER BY finished_at DESC, run LIMIT 200), o AS (SELECT q, row_number() OVER (ORDER BY q) - 1 AS i, count(*) OVER () AS n FROM l) SELECT max(n) AS n, round(CASE WHEN max(n) >= 2 THEN least(5.0, greatest(1.0, max(q) FILTER (i = round_even((n - 1) * 0.75, 0)) * 1.15)) ELSE 1.0 END, 6)::DOUBLE AS factor FROM o",
    "ix21_indices_of_selection": f"{CREDITED}, fa AS (SELECT * FROM author_work WHERE work_id IN (SELECT work_id FROM works WHERE cited_by_count >= 20 AND source_display_name ILIKE '%NATION_1%')),{index_ctes('fa', 'fx')} SELECT fraction_mode, author_id, {', '.join(WHOLE)}, {r(*DOUBLES)} FROM fx",
    "ix22_affiliations": f"{BASE} SELECT work_id, author_id, string_agg(DISTINCT country_codes_csv, '|' ORDER BY country_codes_csv) AS country_codes, string_agg(DISTINCT institution_ids_csv, '|' ORDER BY institution_ids_csv) AS institution_ids FROM authorships GROUP BY 1, 2",
    "rk3_ratings": f"{INDEXED}, lo AS ("
    + " UNION ALL ".join(f"SELECT run_id, fraction_mode, '{m}' AS metric_name, author_id, author_display_name, round(CAST({m} AS DOUBLE), 6) AS score, c, p FROM ix" for m in METRICS)
    + ") SELECT run_id, fraction_mode, metric_name, author_id, author_display_name, score, row_number() OVER (w, c DESC, p DESC, author_id) AS position, rank() OVER w AS rank_competition, dense_rank() OVER w AS rank_dense FROM lo WINDOW w AS (PARTITION BY run_id, fraction_mode, metric_name ORDER BY score DESC)".replace(
        "OVER (w, c DESC, p DESC, author_id)", "OVER (PARTITION BY run_id, fraction_mode, metric_name ORDER BY score DESC, c DESC, p DESC, author_id)"
    ),
    "rk4_metric_ranking": f"{STRICT} SELECT author_id, author_display_name, CAST(h AS DOUBLE) AS score, row_number() OVER (ORDER BY h DESC, c DESC, p DESC, author_display_name, author_id) AS rank_ordinal, rank() OVER (ORDER BY h DESC) AS rank_competition, dense_rank() OVER (ORDER BY h DESC) AS rank_dense, count(*) OVER () AS total FROM s ORDER BY rank_ordinal LIMIT 50",
    "rk6_line_series": f"{STRICT}, b AS (SELECT {', '.join(f'min({m}) AS {m}_lo, max({m}) AS {m}_hi' for m in ('p', 'c', 'h', 'g'))} FROM s) SELECT author_id, {', '.join(f'CAST({m} AS DOUBLE) AS {m}, round(100.0 * ({m} - {m}_lo)::DOUBLE / ({m}_hi - {m}_lo)::DOUBLE, 6) AS {m}_scaled' for m in ('p', 'c', 'h', 'g'))} FROM s, b ORDER BY h DESC, c DESC, p DESC, author_display_name, author_id LIMIT 30",
    "rk8_rank_deltas": f"{RANKED}, {DELTAS} SELECT metric, count(*) AS n_common_authors, round(quantile_cont(abs_rank_delta, 0.5), 6) AS median_abs_delta, round(quantile_cont(abs_rank_delta, 0.9), 6) AS p90_abs_delta, CAST(max(abs_rank_delta) AS DOUBLE) AS max_abs_delta, round(avg(CASE WHEN abs_rank_delta <= 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS share_abs_delta_le_5 FROM d GROUP BY metric",
    "rk9_largest_shifts": f"{RANKED}, {DELTAS} SELECT metric, author_id, baseline_rank, metric_rank, rank_delta, abs_rank_delta FROM d QUALIFY row_number() OVER (PARTITION BY metric ORDER BY abs_rank_delta DESC, author_id DESC) <= 20",
    "rk10_top_overlap": f"""{RANKED}, tp AS (SELECT metric, author_id, row_number() OVER (PARTITION BY metric ORDER BY rank, author_id) AS pos FROM rk), a1 AS (SELECT metric, author_id, unnest([10, 20, 50, 100]) AS cut, pos FROM tp), ac2 AS (SELECT * FROM a1 WHERE pos <= cut),
n AS (SELECT metric, cut, count(*) AS n FROM ac2 GROUP BY 1, 2), bo AS (SELECT a.metric AS metric_a, b.metric AS metric_b, a.cut, count(*) AS overlap FROM ac2 a JOIN ac2 b ON a.author_id = b.author_id AND a.cut = b.cut GROUP BY 1, 2, 3)
SELECT x.metric AS metric_a, y.metric AS metric_b, CAST(x.cut AS BIGINT) AS cut, x.n AS size_a, y.n AS size_b, coalesce(overlap, 0) AS overlap, round(coalesce(overlap, 0)::DOUBLE / least(x.cut, greatest(x.n, y.n)), 6) AS overlap_rate, round(coalesce(overlap, 0)::DOUBLE / (x.n + y.n - coalesce(overlap, 0)), 6) AS jaccard
FROM n x JOIN n y ON x.cut = y.cut LEFT JOIN bo ON bo.metric_a = x.metric AND bo.metric_b = y.metric AND bo.cut = x.cut""",
    "rk11_concentration": f"{LONG}, o AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY greatest(value, 0) DESC, author_id) AS rn FROM lg) SELECT metric, round(sum(greatest(value, 0)) FILTER (rn <= 10) / sum(greatest(value, 0)), 6) AS top10_share, round(sum(greatest(value, 0)) FILTER (rn <= 20) / sum(greatest(value, 0)), 6) AS top20_share FROM o GROUP BY metric",
    "ds1_distribution": f"{LONG} SELECT metric, count(value) AS n, round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.75), 6) AS q3, round(quantile_cont(value, 0.9), 6) AS p90, round(max(value), 6) AS max, round(stddev_samp(value), 6) AS stddev, count(DISTINCT round(value, 9)) AS unique_count, count(*) FILTER (value = 0) AS zero_count, round(count(*) FILTER (value = 0) / count(value), 6) AS zero_rate FROM lg GROUP BY metric",
    "ds2_sparse_histogram": _histogram("value", 8, True),
    "ds3_chart_readiness": f"{LONG}, {FENCES}, n AS (SELECT metric, count(value) AS n FROM lg GROUP BY metric) SELECT metric, CASE WHEN n = 0 THEN 'no_data' WHEN n < 3 THEN 'not_enough_rows' WHEN lo = 0 AND hi = 0 THEN 'all_zero' WHEN lo = hi THEN 'constant_values' ELSE 'ok' END AS histogram, CASE WHEN n = 0 THEN 'no_data' WHEN n < 5 THEN 'not_enough_rows' WHEN lo = 0 AND hi = 0 THEN 'all_zero' WHEN lo = hi THEN 'constant_values' WHEN q1 = q3 THEN 'zero_iqr' ELSE 'ok' END AS boxplot FROM fe JOIN n USING (metric)",
    "ds4_describe": f"""{LONG}, {FENCES}, {moments("value")}, ou AS (SELECT metric, count(*) FILTER (iqr > 0 AND (value < lower_fence OR value > upper_fence)) AS outlier_count_iqr FROM lg JOIN fe USING (metric) GROUP BY metric),
d AS (SELECT metric, count(value) AS n, count(*) - count(value) AS missing, min(value) AS min, max(value) AS max, avg(value) AS mean, stddev_pop(value) AS stddev, quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, count(DISTINCT round(value, 9)) AS unique_count, count(*) FILTER (value = 0) / count(value) AS zero_rate FROM lg GROUP BY metric)
SELECT metric, d.n, missing, {r("min", "max", "mean", "stddev", "q1", "median", "q3", "p90", "p95", "p99")}, round(d.stddev / mean, 6) AS coefficient_of_variation, {r("iqr", "skewness", "excess_kurtosis")}, unique_count, {r("zero_rate")}, round((d.n - unique_count) / d.n, 6) AS tie_rate, outlier_count_iqr, round(outlier_count_iqr / d.n, 6) AS outlier_share_iqr FROM d JOIN fe USING (metric) JOIN mm USING (metric) JOIN ou USING (metric)""",
    "ds5_boxplot": _box("all"),
    "ds5_boxplot_points": f"""{LONG}, {FENCES}, o AS (SELECT metric, author_id, value, lower_fence, upper_fence, CASE WHEN iqr = 0 THEN 'iqr_zero_no_outlier_fence' ELSE 'iqr_1_5' END AS rule, row_number() OVER (PARTITION BY metric ORDER BY value DESC, author_id) AS rn
FROM lg JOIN fe USING (metric) WHERE CASE WHEN iqr = 0 THEN value <> median ELSE value < lower_fence OR value > upper_fence END) SELECT metric, author_id, {r('value', 'lower_fence', 'upper_fence')}, rule, rn FROM o WHERE rn <= 10""",
    "ds6_boxplot_nonzero": _box("nonzero"),
    "ds6_boxplot_central95": _box("central95"),
    "ds7_histogram": _histogram("value"),
    "ds7_histogram_log1p": _histogram("ln(1 + greatest(0, value))", edge=9),  # logarithms are not exact: a value on an edge to nine decimals is in the bin above
    "ds8_outliers": f"{LONG}, {FENCES} SELECT metric, author_id, {r('value', 'lower_fence', 'upper_fence')}, CASE WHEN value < lower_fence THEN 'low' ELSE 'high' END AS side, 'iqr_1_5' AS rule FROM lg JOIN fe USING (metric) WHERE iqr > 0 AND (value < lower_fence OR value > upper_fence)",
    "ds9_normality": f"{LONG}, {moments('value')}, j AS (SELECT *, CASE WHEN n >= 3 AND sd > 0 THEN n / 6 * (pow(skewness, 2) + pow(excess_kurtosis, 2) / 4) END AS jb FROM mm) SELECT metric, n, {r('skewness', 'excess_kurtosis')}, round(jb, 4) AS jarque_bera, round(exp(-jb / 2), 6) AS jarque_bera_p_approx FROM j",
    "ds11_average_ranks": f"{LONG}, {AVG_RANKS} SELECT metric, author_id, round(value, 6) AS value, CAST(avg_rank AS DOUBLE) AS avg_rank FROM ar",
    "ds12_spearman": f"{LONG}, {AVG_RANKS}, wd AS (PIVOT_PLACE) " + " UNION ALL ".join(f"SELECT '{a}' AS metric_a, '{b}' AS metric_b, count(*) AS n, round({corr(a, b)}, 6) AS value FROM wd" for a, b in PAIRS),
    "ds13_pearson_log1p": f"{STRICT}, wd AS (SELECT {', '.join(f'ln(1 + greatest(0, {m}::DOUBLE)) AS {m}' for m in FEW)} FROM s) " + " UNION ALL ".join(f"SELECT '{a}' AS metric_a, '{b}' AS metric_b, count(*) AS n, round({corr(a, b)}, 6) AS value FROM wd" for a, b in PAIRS),
    "ds19_dependence": f"{STRICT}, {long(sorted({*FEW, *stats.FACTORS.values()}))}, {AVG_RANKS} "
    + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, '{k}' AS factor, round(v, 6) AS spearman_rho, CASE WHEN v IS NULL THEN NULL WHEN v > 0 THEN 'positive' WHEN v < 0 THEN 'negative' ELSE 'none' END AS direction FROM (SELECT {corr('a.avg_rank', 'b.avg_rank')} AS v FROM ar a JOIN ar b USING (author_id) WHERE a.metric = '{m}' AND b.metric = '{f}')"
        for m in FEW
        for k, f in stats.FACTORS.items()
        if m != f
    ),
    "sl1_snapshot_slice": f"WITH {WORKS} SELECT work_id AS id FROM works WHERE (publication_date IS NULL OR publication_date >= '1996-01-01') AND (publication_date IS NULL OR publication_date <= '1998-12-31') AND lower(type) IN ('article', 'review') AND {GUARD}",
    "sl2_subject_slice": f"WITH {WORKS} SELECT work_id AS id FROM works WHERE primary_subfield_short_id = 'BUILDING'",
    "sl4_work_filter": f"WITH {WORKS} SELECT work_id FROM works WHERE type IN ('article', 'preprint') AND language = 'l1' AND open_access_is_oa AND cited_by_count >= 10 AND source_display_name ILIKE '%NATION_1%'",
    "sl6_any_topic": f"WITH {WORKS},{TOPICS} SELECT work_id FROM works WHERE work_id IN (SELECT work_id FROM work_topics WHERE topic_id ILIKE '%S3' OR topic_display_name ILIKE '%S3%')",
    "sl7_keyword": f"WITH {WORKS},{TOPICS} SELECT work_id FROM works WHERE work_id IN (SELECT work_id FROM work_topics WHERE topic_id ILIKE '%urgent%' OR topic_display_name ILIKE '%urgent%') OR {_topics_match('urgent')}",
    "sl8_text_match": f"WITH {WORKS} SELECT work_id FROM works WHERE {_topics_match('machinery')}",
    "sl9_doi": f"WITH {WORKS} SELECT work_id FROM works WHERE regexp_replace(lower(trim(doi)), '^(https?://(dx\\.)?doi\\.org/|doi:\\s*)', '') IN ('10.1/17', '10.1/18')",
    "sl10_person_filter": f"{BASE} SELECT DISTINCT work_id, author_id FROM authorships WHERE country_codes_csv = 'NC' AND institution_ids_csv ILIKE '%I1%' AND author_orcid ILIKE '%orcid.org/%'",
    "sl17_facets": f"{BASE}, e AS (SELECT 'type' AS facet, type AS value, work_id FROM works UNION ALL SELECT 'year', CAST(publication_year AS VARCHAR), work_id FROM works UNION ALL SELECT DISTINCT 'country', country_codes_csv, work_id FROM authorships), n AS (SELECT facet, value, count(*) AS count FROM e GROUP BY 1, 2) SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY facet ORDER BY count DESC, value) <= 20",
    "sl19_size_class": f"WITH {WORKS}, n AS (SELECT type, count(*) AS n FROM works GROUP BY type) SELECT type, n, CASE WHEN n <= 0 THEN 'no_data' WHEN n <= 50000 THEN 'can_fetch' WHEN n <= 300000 THEN 'medium' WHEN n <= 1000000 THEN 'large' ELSE 'very_large' END AS size_class FROM n",
    "p1_table_query": f"{STRICT} SELECT author_id, author_display_name, p, h, round(c, 6) AS c FROM s WHERE CAST(h AS DOUBLE) >= 15 AND author_display_name ILIKE '%small%' ORDER BY h DESC, c DESC, p DESC, author_display_name, author_id LIMIT 40 OFFSET 5",
    "p1_page_info": f"{STRICT}, n AS (SELECT count(*) AS total FROM s WHERE CAST(h AS DOUBLE) >= 15 AND author_display_name ILIKE '%small%') SELECT total, least(greatest(total - 5, 0), 40) AS page_rows, total > 45 AS has_next FROM n",
    "p6_related_authors": f"{STRICT} SELECT author_id, p FROM s WHERE author_id IN (SELECT author_id FROM authorships WHERE country_codes_csv ILIKE '%ND%')",
    "p8_keyset_page": f"{STRICT}, o AS (SELECT author_id, author_display_name, h, c, p, row_number() OVER (ORDER BY h DESC, c DESC, p DESC, author_display_name, author_id) AS rn FROM s) SELECT author_id, h, p FROM o WHERE rn BETWEEN 21 AND 40",
    "p10_select_rows": f"{STRICT} SELECT author_id, h FROM s WHERE CAST(p AS DOUBLE) <= 30 AND (author_id ILIKE '%7%' OR author_display_name ILIKE '%7%') ORDER BY h DESC, author_id LIMIT 25",
    "p14_author_works": f"{CREDITED} SELECT work_id, display_name, publication_year, cited_by_count FROM works WHERE work_id IN (SELECT work_id FROM author_work WHERE author_id = 'A17') ORDER BY cited_by_count DESC, work_id LIMIT 100",
    "p15_work_authorships": f"{BASE} SELECT author_seq, author_id, author_display_name FROM authorships WHERE work_id = 'https://example.org/W17'",
    "p17_catalog_search": "SELECT 'source' AS entity_type, n_name AS name, count(*) AS works_count FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE lower(n_name) LIKE '%nation_1%' GROUP BY n_name ORDER BY works_count DESC, name LIMIT 8",
    "p19_catalog_status": f"{BASE} SELECT 'author' AS entity_type, count(DISTINCT author_id) AS n FROM authorships UNION ALL SELECT 'source', count(DISTINCT source_id) FROM works UNION ALL SELECT 'topic', count(DISTINCT primary_topic_id) FROM works",
    "nz2_works": f"WITH {WORKS} SELECT * REPLACE ({', '.join(f'CASE WHEN primary_topic_id IS NOT NULL THEN {c} END AS {c}' for c in ('primary_subfield_id', 'primary_subfield_short_id', 'primary_field_id', 'primary_domain_id'))}) FROM works",
    "nz5_authorships": f"{BASE} SELECT work_id, author_seq, CASE WHEN author_id <> 'A9999999999' THEN author_id END AS author_id, author_display_name, author_position, author_orcid, author_display_name AS raw_author_name, is_corresponding, institution_ids_csv, country_codes_csv, authorships_count_raw, authors_count_reported, valid_author_ids_count, round(1.0 / authors_count_reported, 6)::DOUBLE AS frac_weight_strict, round(CASE WHEN NOT qf_null_author_id AND NOT qf_deleted_author_id THEN 1.0 / valid_author_ids_count END, 6)::DOUBLE AS frac_weight_renorm, qf_null_author_id, qf_deleted_author_id, qf_duplicate_authorship AND NOT qf_null_author_id AS qf_duplicate_authorship, qf_authorship_truncated, qf_author_count_mismatch, qf_missing_primary_topic FROM authorships",
    "nz9_work_topics": f"WITH {WORKS},{TOPICS} SELECT * FROM work_topics",
    "nz10_author_institutions": f"{BASE} SELECT work_id, author_seq, institution_ids_csv AS institution_id, country_codes_csv AS country_code FROM authorships",
    "nz11_author_countries": f"{BASE} SELECT work_id, author_seq, country_codes_csv AS country_code FROM authorships",
    "nz12_quality_report": f"{BASE}, w AS (SELECT * FROM works), a AS (SELECT * FROM authorships) SELECT 'raw_works' AS issue, count(*) AS count FROM w UNION ALL SELECT 'works_without_id', 0 UNION ALL SELECT 'duplicate_works', 0 UNION ALL SELECT 'works', count(*) FROM w UNION ALL SELECT 'works_truncated', count(*) FROM w WHERE is_authors_truncated UNION ALL SELECT 'works_without_primary_topic', count(*) FROM w WHERE primary_topic_id IS NULL UNION ALL SELECT 'works_retracted', count(*) FROM w WHERE is_retracted UNION ALL SELECT 'authorships', count(*) FROM a UNION ALL SELECT 'authorships_null_author_id', count(*) FROM a WHERE qf_null_author_id UNION ALL SELECT 'authorships_deleted_author_id', count(*) FROM a WHERE qf_deleted_author_id UNION ALL SELECT 'authorships_duplicate_author_id', count(*) FROM a WHERE qf_duplicate_authorship AND NOT qf_null_author_id",
    "nz13_quality_funnel": f"{INDEXED} SELECT 'raw_works' AS stage, count(*) AS count FROM works UNION ALL SELECT 'works', count(*) FROM works UNION ALL SELECT 'authorships', count(*) FROM authorships UNION ALL SELECT 'valid_authorships', count(*) FROM authorships WHERE NOT qf_null_author_id AND NOT qf_deleted_author_id UNION ALL SELECT 'authors_with_indices', count(DISTINCT author_id) FROM ix",
    "nz14_truncated": f"WITH {WORKS} SELECT work_id AS id FROM works WHERE is_authors_truncated OR authors_count_reported > authorships_count_raw",
    "nz15_backfill": f"WITH {WORKS}, t AS (SELECT *, is_authors_truncated OR authors_count_reported > authorships_count_raw AS need, CAST(split_part(work_id, 'W', 2) AS BIGINT) % 80 = 3 AS given FROM works) SELECT count(*) FILTER (need) AS attempted, count(*) FILTER (need AND given AND authorships_count_raw > 0) AS replaced, count(*) FILTER (need AND NOT (given AND authorships_count_raw > 0)) AS unresolved FROM t",
    "nz16_integrity": f"WITH {WORKS} SELECT type, count(*) AS actual, array_to_string(list_filter([CASE WHEN count(*) <> 5000 THEN 'record_count_mismatch' END, CASE WHEN count(*) FILTER (is_retracted) > 0 THEN 'parse_errors' END], lambda x: x IS NOT NULL), ',') AS errors FROM works GROUP BY type",
    "nz17_eligibility": f"WITH {WORKS} SELECT source_id, CASE WHEN count(*) FILTER (is_authors_truncated) > 15 THEN 'pilot_ready' ELSE 'final_reproducible' END AS status FROM works GROUP BY source_id",
    "io10_row_counts": f"{BASE},{TOPICS} SELECT 'works' AS \"table\", count(*) AS rows FROM works UNION ALL SELECT 'authorships', count(*) FROM authorships UNION ALL SELECT 'work_topics', count(*) FROM work_topics",
    "io12_manifest_partitions": "SELECT strftime(ts, '%Y-%m-%d') AS partition, count(*) AS entries, CAST(sum(user_id) AS BIGINT) AS records, CAST(sum(event_id) AS BIGINT) AS bytes FROM events GROUP BY 1",
    "io14_manifest_totals": "SELECT CAST(sum(user_id) AS BIGINT) AS records, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors, CAST(sum(event_id) AS BIGINT) AS bytes FROM events",
    "io6_csv_round_trip": f"WITH {WORKS} SELECT work_id, display_name, publication_year, cited_by_count, is_retracted FROM works",
    "io2_tolerant_scan": "SELECT count(*) FILTER (o_orderkey % 13 <> 0) AS records, count(*) FILTER (o_orderkey % 13 = 0) AS errors FROM orders",
    "st1_incremental_ingest": f"WITH {WORKS} SELECT work_id AS id, cited_by_count FROM works WHERE type = 'article'",
    "io8_sorted_export": f"WITH {WORKS} SELECT row_number() OVER (ORDER BY cited_by_count DESC, work_id) AS place, work_id || ',' || display_name || ',' || cited_by_count AS line FROM works UNION ALL SELECT 0, 'work_id,display_name,cited_by_count'",
    "io13_manifest_check": f"""WITH {WORKS}, m AS (SELECT DISTINCT publication_date[1:7] AS month FROM works), k AS (SELECT *, CASE WHEN month LIKE '%-05' THEN month[1:5] || '04' ELSE month END AS key FROM m), z AS (SELECT key, count(*) > 1 AS again FROM k GROUP BY 1)
SELECT k.key, array_to_string(list_filter([CASE WHEN month LIKE '%-03' THEN 'missing' END, CASE WHEN month LIKE '%-01' THEN 'failed' END, CASE WHEN month LIKE '%-01' OR month LIKE '%-02' THEN 'checksum' END, CASE WHEN again THEN 'repeated_key' END], lambda x: x IS NOT NULL), ',') AS problems FROM k JOIN z ON z.key = k.key""",
    "io3_packs": f"""WITH {WORKS}, k AS (SELECT *, CAST(split_part(work_id, 'W', -1) AS BIGINT) AS number FROM works), m AS (SELECT *, number // 1000 AS pack, row_number() OVER (PARTITION BY number // 1000 ORDER BY number) AS i FROM k),
w AS (SELECT 'works-' || pack || '.json' AS file, work_id AS id, display_name AS title FROM m WHERE cited_by_count % 7 <> 0 AND (pack % 4 <> 2 OR i = 1)) SELECT *, count(*) OVER (PARTITION BY file) AS records, 'ok' AS status FROM w""",
    "st1_changed_files": f"WITH {WORKS}, m AS (SELECT work_id AS id, type, cited_by_count AS c, publication_date[1:7] IN ('1995-03', '1997-11') AS changed FROM works WHERE type = 'article' AND publication_date[1:7] <> '1996-02') SELECT id, type, CASE WHEN changed THEN c + 1000 ELSE c END AS cited_by_count FROM m WHERE NOT changed OR c % 2 = 0",
    "st2_repaired_chunks": f"WITH {WORKS} SELECT work_id AS id, type, cited_by_count FROM works",
    "ud2_custom_metric": f"{STRICT}, z AS (SELECT author_id, round(coalesce(c_frac / nullif(p, 0), 0) + ln(1 + h::DOUBLE) - i10 % 7, 6) AS custom_mix, p FROM s), q AS (SELECT *, row_number() OVER (ORDER BY author_id) AS i FROM z) SELECT author_id, custom_mix FROM q",
    "ud3_percentile_metric": f"{STRICT}, z AS (SELECT author_id, CASE WHEN h > 0 THEN (rank() OVER (PARTITION BY h > 0 ORDER BY h) + (count(*) OVER (PARTITION BY h) - 1) / 2.0) / count(*) OVER (PARTITION BY h > 0) ELSE 0 END AS pr FROM s) SELECT author_id, round(100 * pr::DOUBLE, 6) AS custom_rank FROM z",
    "ch1_top_cohort": f"{STRICT}, t AS (SELECT author_id FROM s ORDER BY h DESC, c DESC, p DESC, author_display_name, author_id LIMIT 25) SELECT count(*) AS n, sha256(string_agg(author_id, chr(10) ORDER BY author_id)) AS checksum FROM t",
    "ch2_threshold_cohort": f"{STRICT} SELECT author_id FROM s WHERE p >= 25 AND h >= 15 AND c_frac >= 100",
    "ch6_cohort_page": f"{STRICT} SELECT author_id, h FROM s WHERE p >= 25 ORDER BY h DESC, c DESC, p DESC, author_display_name, author_id LIMIT 20 OFFSET 10",
    "ch7_cohort_statistics": f"{STRICT}, s2 AS (SELECT * FROM s WHERE p >= 25), {long(['p', 'h', 'c_frac'], 's2')}, l2 AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY metric) AS nn FROM lg), {moments('value')} SELECT metric, mm.n, round(min(value), 6) AS min, "
    + ", ".join(f"round(max(value) FILTER (i = round_even((nn - 1) * {q}, 0)), 6) AS {n}" for n, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)))
    + ", round(max(value), 6) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS stddev, round(coalesce(max(skewness), 0), 6) + 0 AS skewness, round(coalesce(max(excess_kurtosis), 0), 6) + 0 AS excess_kurtosis FROM l2 JOIN mm USING (metric) GROUP BY metric, mm.n",
    "rs1_bootstrap": f"""{STRICT}, w AS (SELECT {", ".join(f"row_number() OVER (ORDER BY {m} DESC, c DESC, p DESC, author_id) AS {m}" for m in ("h", "c_frac", "g"))}, row_number() OVER (ORDER BY author_id) - 1 AS slot, count(*) OVER () AS n FROM s),
d AS (SELECT it, unnest(range(0, n)) AS k, n FROM (SELECT unnest(range(0, 200)) AS it, count(*) AS n FROM s)), x AS (SELECT it, CAST('0x' || substr(md5('42:' || it || ':' || k // 2), 1 + 15 * CAST(k % 2 AS INTEGER), 15) AS BIGINT) % n AS slot FROM d),
t AS (SELECT it, slot, count(*) AS times FROM x GROUP BY 1, 2), rr AS (SELECT it, {", ".join(f"sum(times) OVER (PARTITION BY it ORDER BY {m}) AS {m}" for m in ("h", "c_frac", "g"))} FROM t JOIN w USING (slot)) """
    + " UNION ALL ".join(f"SELECT '{a}' AS metric_a, '{b}' AS metric_b, count(v) AS iterations, (SELECT count(*) FROM s) AS sample_size, (SELECT round(corr({a}, {b}), 6) FROM w) AS estimate, round(quantile_cont(v, 0.025), 6) AS ci_low, round(quantile_cont(v, 0.975), 6) AS ci_high, 'ok' AS status FROM (SELECT it, corr({a}, {b}) AS v FROM rr GROUP BY it)" for a, b in (("h", "c_frac"), ("h", "g"))),
    "rs2_permutation": f"""{STRICT}, w AS (SELECT author_id, {", ".join(f"row_number() OVER (ORDER BY {m} DESC, c DESC, p DESC, author_id) <= 20 AS {m}" for m in ("h", "c_frac", "p", "g", "n_truncated_works"))} FROM s),
x AS (SELECT it, w.*, row_number() OVER (PARTITION BY it ORDER BY substr(md5('42:' || it || ':' || author_id), 1, 15), author_id) AS place FROM w, (SELECT unnest(range(1, 201)) AS it)),
hi AS (SELECT it, {", ".join(f"count(*) FILTER ({m}) AS {m}" for m in ("h", "p"))} FROM x WHERE place <= 20 GROUP BY it), k AS ("""
    + " UNION ALL ".join(f"SELECT '{a}' AS metric_a, '{b}' AS metric_b, (SELECT count(*) FROM w WHERE {a} AND {b}) AS overlap, ((SELECT count(*) FROM hi WHERE {a} >= (SELECT count(*) FROM w WHERE {a} AND {b})) + 1) / 201.0 AS p, (SELECT count(DISTINCT {a}) <= 1 OR count(DISTINCT {b}) <= 1 FROM s) AS flat" for a, b in (("h", "c_frac"), ("p", "g"), ("h", "n_truncated_works")))
    + "), q AS (SELECT *, row_number() OVER (ORDER BY p, metric_a, metric_b) - 1 AS i, count(*) OVER () AS m FROM k WHERE NOT flat), ho AS (SELECT metric_a, metric_b, max(least(1.0, p * (m - i))) OVER (ORDER BY p, metric_a, metric_b ROWS UNBOUNDED PRECEDING) AS p_holm FROM q) SELECT metric_a, metric_b, 20 AS top_n, CASE WHEN NOT flat THEN overlap END AS overlap, CASE WHEN NOT flat THEN round(overlap / 20, 6) END AS overlap_rate, CASE WHEN NOT flat THEN round(p, 6) END AS p_value, CASE WHEN flat THEN 0 ELSE 200 END AS iterations, CASE WHEN flat THEN 'constant_metric' ELSE 'ok' END AS status, round(p_holm, 6) AS p_holm FROM k LEFT JOIN ho USING (metric_a, metric_b)",
    "rs3_holm": "WITH t AS (SELECT s_suppkey AS metric_a, s_nationkey AS metric_b, (s_acctbal::DOUBLE + 1000) / 11000000 AS p_value FROM supplier), k AS (SELECT *, row_number() OVER (ORDER BY p_value, metric_a, metric_b) - 1 AS i, count(*) OVER () AS m FROM t) SELECT metric_a, metric_b, round(p_value, 6) AS p_value, round(max(least(1.0, p_value * (m - i))) OVER (ORDER BY p_value, metric_a, metric_b ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM k",
    "rs4_convergence": f"""{STRICT}, a AS (SELECT *, row_number() OVER (ORDER BY author_id) AS pos, row_number() OVER (ORDER BY h DESC, c DESC, p DESC, author_id) AS full_rank, count(*) OVER () AS n FROM s),
z AS (SELECT DISTINCT size, n FROM (SELECT unnest([500, 1000, 2000, 5000, n]) AS size, n FROM (SELECT count(*) AS n FROM s)) WHERE size <= n),
rr AS (SELECT z.size, z.n, full_rank, row_number() OVER (PARTITION BY z.size ORDER BY h DESC, c DESC, p DESC, author_id) AS own FROM a JOIN z ON pos <= size)
SELECT CAST(size AS BIGINT) AS prefix_size, CAST(n AS BIGINT) AS full_size, round(size / n::DOUBLE, 6) AS coverage_ratio, round(corr(own, full_rank), 6) AS spearman_vs_full, count(*) FILTER (own <= 20 AND full_rank <= 20) AS top_overlap,
round(count(*) FILTER (own <= 20 AND full_rank <= 20) / least(20, n, size)::DOUBLE, 6) AS top_overlap_rate FROM rr GROUP BY size, n""",
    "rs5_methodology": f"{STRICT}, {long(['h', 'c', 'n_truncated_works'])} SELECT metric, count(DISTINCT round(value, 12)) <= 1 AS \"constant\", max(abs(value)) = 0 AS all_zero, CASE WHEN count(DISTINCT round(value, 12)) <= 1 THEN 'constant_metric' ELSE 'ok' END AS status FROM lg GROUP BY metric",
    "rs6_ordinal_spearman": f"{STRICT}, rr AS (SELECT " + ", ".join(f"row_number() OVER (ORDER BY {m} DESC, c DESC, p DESC, author_id) AS {m}" for m in ("h", "c_frac", "g")) + " FROM s) " + " UNION ALL ".join(f"SELECT '{a}' AS metric_a, '{b}' AS metric_b, count(*) AS n, round(corr({a}, {b}), 6) AS value FROM rr" for a, b in (("h", "c_frac"), ("h", "g"))),
}
SQL["ds12_spearman"] = SQL["ds12_spearman"].replace("PIVOT_PLACE", "SELECT author_id, " + ", ".join(f"max(avg_rank) FILTER (metric = '{m}') AS {m}" for m in FEW) + " FROM ar GROUP BY author_id")
SQL["ds16_rank_summary"] = f"""SELECT metric, n AS n_authors, mean, median, stddev, min, q1 AS p25, q3 AS p75, p90, p95, p99, max, zero_rate, tie_rate, unique_count, outlier_share_iqr, top10_share, top20_share,
{_group("metric")} AS metric_group FROM ({SQL["ds4_describe"]}) JOIN ({SQL["rk11_concentration"]}) USING (metric)"""
_EXPORTED = (("p", "h"), ("p", "c_frac"), ("h", "c_frac"))
_EITHER = lambda a, b: f"((metric_a = '{a}' AND metric_b = '{b}') OR (metric_a = '{b}' AND metric_b = '{a}'))"


def _tau(pairs, keep: str = "", group: str = "", n: str = "(SELECT count(*) FROM k)") -> str:
    """tau-b of every pair of metrics by comparing all pairs of rows of ``k``."""
    value = lambda a, b: f"round(sum({a} * {b}) / nullif(sqrt(sum({a} * {a})::DOUBLE * sum({b} * {b})::DOUBLE), 0), 6) + 0"
    one = lambda a, b: f"SELECT {keep}'{a}' AS metric_a, '{b}' AS metric_b, {n} AS n, {value(a, b)} AS value, false AS skipped FROM pr {group}"
    return " UNION ALL ".join(one(a, b) for a, b in pairs)


_SIGNS = lambda names: ", ".join(f"sign(x.{m} - y.{m}) AS {m}" for m in names)
_TAU = ["p", "h", "c_frac"]
SQL["ds14_kendall"] = (
    f"{STRICT}, k AS (SELECT author_id, p, h, c_frac FROM s), pr AS (SELECT {_SIGNS(_TAU)} FROM k x JOIN k y ON x.author_id < y.author_id) {_tau([(a, b) for i, a in enumerate(_TAU) for b in _TAU[i + 1 :]])}"
    + "".join(f" UNION ALL SELECT '{m}', '{m}', (SELECT count(*) FROM k), CASE WHEN (SELECT count(*) FROM k) >= 2 THEN 1.0 END, false" for m in _TAU)
)
SQL["ds14_kendall_by_institution"] = f"""{STRICT}, k AS (SELECT DISTINCT institution_ids_csv AS institution, author_id, p, h, c_frac FROM s JOIN authorships USING (author_id)),
sz AS (SELECT institution, count(*) AS n FROM k GROUP BY 1), pr AS (SELECT sz.institution, sz.n, {_SIGNS(_TAU)} FROM sz LEFT JOIN (k x JOIN k y ON x.institution = y.institution AND x.author_id < y.author_id) ON x.institution = sz.institution)
{_tau([(a, b) for i, a in enumerate(_TAU) for b in _TAU[i + 1 :]], "institution, ", "GROUP BY institution, n", "n")}"""
_TAU4 = f"{STRICT}, k AS (SELECT author_id, p, h, c_frac, g FROM s), pr AS (SELECT {_SIGNS([*_TAU, 'g'])} FROM k x JOIN k y ON x.author_id < y.author_id) {_tau([('p', 'h'), ('p', 'c_frac'), ('p', 'g'), ('h', 'c_frac'), ('h', 'g'), ('c_frac', 'g')])}"
SQL["p4_indexed_search"] = SQL["p4_search"]
SQL["ds24_correlation_rows"] = " UNION ALL ".join(f"SELECT '{method}' AS method, '{a}' AS left, '{b}' AS right, value FROM ({SQL[key]}) WHERE {_EITHER(a, b)}" for method, key in (("spearman", "ds12_spearman"), ("pearson_log1p", "ds13_pearson_log1p")) for a, b in _EXPORTED) + " UNION ALL " + " UNION ALL ".join(
    f"SELECT 'kendall_tau_b', metric_a, metric_b, value FROM ({SQL['ds14_kendall']}) WHERE metric_a = '{a}' AND metric_b = '{b}'" for a, b in _EXPORTED
)
SQL["ds21_warnings"] = f"""{LONG}, {FENCES}, n AS (SELECT count(*) AS n FROM s)
SELECT 'no_authors' AS code, '' AS detail FROM n WHERE n = 0 UNION ALL SELECT 'under_5_authors', '' FROM n WHERE n BETWEEN 1 AND 4 UNION ALL SELECT 'under_20_authors', '' FROM n WHERE n BETWEEN 5 AND 19
UNION ALL SELECT 'rank_cut', '' FROM n WHERE n > 100 UNION ALL SELECT 'kendall_skipped', '' FROM n WHERE n > 1000 UNION ALL SELECT 'zero_iqr', metric FROM fe WHERE iqr = 0"""
_DS15 = ["p", "h", "c_frac", "g"]
_DS15_PAIRS = [(a, b) for i, a in enumerate(_DS15) for b in _DS15[i + 1 :]]
SQL["ds15_pairwise"] = f"""WITH sp AS ({SQL["ds12_spearman"]}), pe AS ({SQL["ds13_pearson_log1p"]}), ov AS ({SQL["rk10_top_overlap"]}), de AS ({SQL["rk8_rank_deltas"]}), ke AS ({_TAU4}) """ + " UNION ALL ".join(
    f"""SELECT '{a}' AS metric_a, '{b}' AS metric_b, (SELECT value FROM sp WHERE {_EITHER(a, b)}) AS spearman, (SELECT value FROM pe WHERE {_EITHER(a, b)}) AS pearson_log1p, (SELECT value FROM ke WHERE metric_a = '{a}' AND metric_b = '{b}') AS kendall_tau_b,
{", ".join(f"(SELECT overlap_rate FROM ov WHERE metric_a = '{a}' AND metric_b = '{b}' AND cut = {c}) AS top{c}_overlap_rate" for c in (10, 20, 50))},
{", ".join(f"(SELECT {c} FROM de WHERE metric = '{b if a == 'h' else a if b == 'h' else '-'}') AS {c}" for c in ("median_abs_delta", "p90_abs_delta", "max_abs_delta", "share_abs_delta_le_5"))}, {_group(f"'{a}'")} AS group_a, {_group(f"'{b}'")} AS group_b"""
    for a, b in _DS15_PAIRS
)


def _normal_quantile(p: str) -> str:
    def poly(x: str, terms: tuple) -> str:
        out = f"{terms[0]!r}::DOUBLE"
        for t in terms[1:]:
            out = f"(({out}) * {x} + {t!r}::DOUBLE)"
        return out

    a, b, c, d = stats.QUANTILE
    tail = lambda q: f"({poly(q, c)} / {poly(q, (*d, 1.0))})"
    low, high, mid = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))", f"({p} - 0.5)"
    return f"CASE WHEN {p} < 0.02425 THEN {tail(low)} WHEN {p} > 1 - 0.02425 THEN -{tail(high)} ELSE {mid} * {poly(f'({mid} * {mid})', a)} / {poly(f'({mid} * {mid})', (*b, 1.0))} END"


SQL["ds10_qq_points"] = f"""{STRICT}, {long(["h", "c_frac"])}, o AS (SELECT metric, value, row_number() OVER (PARTITION BY metric ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY metric) AS n FROM lg WHERE value IS NOT NULL),
g AS (SELECT metric, n, unnest(range(0, least(101, n))) AS k FROM (SELECT DISTINCT metric, n FROM o)), w AS (SELECT DISTINCT metric, CAST(CASE WHEN n = 1 THEN 0 ELSE round_even(k * (n - 1)::DOUBLE / (least(101, n) - 1), 0) END AS BIGINT) AS idx FROM g),
q AS (SELECT o.metric, idx, (idx + 0.5)::DOUBLE / n AS p, value FROM w JOIN o ON o.metric = w.metric AND i = idx)
SELECT metric, idx AS "index", round({_normal_quantile("p")}, 6) + 0 AS theoretical, round(value, 6) + 0 AS sample FROM q"""


SQL["ds19_dependence"] = f"""WITH x AS ({SQL["ds19_dependence"]}), y AS ({SQL["ds4_describe"]})
SELECT metric, factor, spearman_rho, abs(spearman_rho) AS abs_spearman_rho, direction, tie_rate, zero_rate, outlier_share_iqr, coefficient_of_variation FROM x JOIN y USING (metric)"""


def _findings() -> str:
    """The threshold rules over the statistics' own SQL: CTE ``f`` with the findings."""
    t, any_ = stats.THRESHOLDS, lambda i: f"(coalesce(abs(skewness) >= {t['skewness'][i]}, false) OR coalesce(excess_kurtosis >= {t['kurtosis'][i]}, false) OR coalesce(jarque_bera_p_approx < {t['normality_p'][i]}, false))"
    level = lambda high: f"CASE WHEN {high} THEN 'high' ELSE 'medium' END"
    row = lambda prefix, kind, severity, value, source, base="NULL": f"SELECT '{prefix}:' || {'' if base == 'NULL' else base + " || ':' || "}metric AS id, '{kind}' AS type, metric, {base} AS baseline_metric, {severity} AS severity, {value} AS value FROM {source}"
    rows = [row("heavy_tail", "heavy_tail_distribution", level(any_(1)), "skewness", f"d4 JOIN (SELECT metric, jarque_bera_p_approx FROM d9) USING (metric) WHERE {any_(0)}")]
    for kind, column, prefix in (("zero_inflation", "zero_rate", "zero_inflation"), ("high_tie_rate", "tie_rate", "tie_rate")):
        rows.append(row(prefix, kind, level(f"{column} >= {t[column][1]}"), column, f"d4 WHERE {column} >= {t[column][0]}"))
    rows += [row(kind, kind, level(f"abs_spearman_rho >= {high}"), "spearman_rho", f"ca WHERE factor = '{kind}' AND abs_spearman_rho >= {least}") for kind, (least, high) in stats.DEPENDENCE.items()]
    for m, kind, prefix in (("p", "productivity_metric", "metric_identity"), ("c", "citation_volume_metric", "metric_identity"), ("islv", "balanced_candidate_metric", "balanced_candidate"), ("iupv_s", "balanced_candidate_metric", "balanced_candidate")):
        rows.append(row(prefix, kind, "'informational'", "NULL", f"(SELECT '{m}' AS metric)"))
    shift = f"(SELECT dl.*, jaccard, (SELECT value FROM sp WHERE (metric_a = 'h' AND metric_b = dl.metric) OR (metric_b = 'h' AND metric_a = dl.metric)) AS spearman FROM dl JOIN ov ON ov.metric_a = 'h' AND ov.metric_b = dl.metric AND cut = 100)"
    i, n = stats.INSTABILITY, "(SELECT n FROM nn)"
    rows.append(row("rank_instability", "rank_instability", level(f"p90_abs_delta >= greatest(10, {i['high_share']} * {n}) OR jaccard < {i['high_jaccard']}"), "p90_abs_delta", f"{shift} WHERE p90_abs_delta >= greatest(5, {i['share']} * {n}) OR jaccard < {i['jaccard']}", "'h'"))
    rows.append(row("rank_agreement", "rank_agreement", "'informational'", "spearman", f"{shift} WHERE spearman >= {stats.AGREEMENT['spearman']} AND jaccard >= {stats.AGREEMENT['jaccard']}", "'h'"))
    parts = {"d4": "ds4_describe", "d9": "ds9_normality", "ca": "ds19_dependence", "ov": "rk10_top_overlap", "dl": "rk8_rank_deltas", "sp": "ds12_spearman"}
    return "WITH " + ", ".join(f"{k} AS ({SQL[v]})" for k, v in parts.items()) + f", nn AS (SELECT count(*) AS n FROM ({STRICT} SELECT * FROM s)), f AS (" + " UNION ALL ".join(rows) + ")"


FINDINGS = _findings()
SQL["ds18_findings"] = f"{FINDINGS} SELECT id, type, metric, baseline_metric, severity, round(value, 6) + 0 AS value FROM f"
SQL["ds19_finding_summary"] = f"""{FINDINGS}, li AS (SELECT id, row_number() OVER (ORDER BY CASE severity WHEN 'high' THEN 0 ELSE 1 END, type, metric, id) AS i FROM f WHERE severity IN ('high', 'medium'))
SELECT count(*) AS n_findings, count(*) FILTER (severity = 'high') AS high_count, count(*) FILTER (severity = 'medium') AS medium_count, string_agg(DISTINCT metric, ',' ORDER BY metric) FILTER (type = 'balanced_candidate_metric') AS candidate_metrics, (SELECT string_agg(id, ',' ORDER BY i) FROM li WHERE i <= 8) AS limitations FROM f"""
_ROLES = {"heavy_tail_distribution": "distribution_limits", "high_tie_rate": "index_limitations", "zero_inflation": "index_limitations", "rank_instability": "rank_comparison", "rank_agreement": "rank_comparison", "balanced_candidate_metric": "candidate_metric"} | dict.fromkeys(stats.DEPENDENCE, "dependence_limits")
SQL["ds20_conclusion"] = f"""{FINDINGS}, ro AS (SELECT *, CASE WHEN type = 'top1_dominance_dependence' AND value < 0 THEN 'correction_effects' {" ".join(f"WHEN type = '{k}' THEN '{v}'" for k, v in _ROLES.items())} END AS role FROM f)
SELECT role, string_agg(DISTINCT id, ',' ORDER BY id) AS evidence_finding_ids, string_agg(DISTINCT metric, ',' ORDER BY metric) AS evidence_metrics FROM ro WHERE role IS NOT NULL GROUP BY role
UNION ALL SELECT unnest(['scope', 'final_caution']), '', ''"""
SQL["sl16_size_estimate"] = f"""WITH {WORKS}, b AS (SELECT CAST(strlen('{{"id":"' || work_id || '","publication_year":' || publication_year || ',"cited_by_count":' || cited_by_count || ',"type":"' || type || '"}}') + 1 AS DOUBLE) AS b, row_number() OVER (ORDER BY md5(work_id), work_id) AS i FROM works),
o AS (SELECT b, row_number() OVER (ORDER BY b) - 1 AS i, count(*) OVER () AS n FROM b WHERE i <= 1000), q AS (SELECT avg(b) AS mean, max(b) FILTER (i = round_even((n - 1) * 0.9, 0)) AS p90, max(b) FILTER (i = round_even((n - 1) * 0.95, 0)) AS p95 FROM o),
h AS (SELECT *, greatest(p90, mean) AS high, greatest(p95, p90, mean) AS higher FROM q), r1 AS (SELECT *, mean * 1000000 AS raw, floor(high * 1000000) AS raw_p90, floor(higher * 1000000) AS raw_p95 FROM h),
r2 AS (SELECT *, floor(greatest(raw_p95, high * 1000000, raw * {filters.STORAGE["download_of_raw"]}::DOUBLE)) AS download FROM r1),
r3 AS (SELECT *, floor(greatest(download * {filters.STORAGE["final_of_download"]}::DOUBLE, high * 1000000 * {filters.STORAGE["final_of_raw"]}::DOUBLE)) AS final, floor(greatest({filters.STORAGE["tables_of_record"]} * 1000000, raw_p90 * {filters.STORAGE["tables_of_raw"]}::DOUBLE)) AS tables, floor(greatest(download * {filters.STORAGE["temp_of_download"]}::DOUBLE, raw_p90 * {filters.STORAGE["temp_of_raw"]}::DOUBLE)) AS temp FROM r2)
SELECT {", ".join(f"round({c}, 6) AS {c}_bytes" for c in ("mean", "p90", "p95"))}, {", ".join(f"CAST(floor({c}) AS BIGINT) AS {c}_bytes" for c in ("raw", "raw_p90", "download", "final", "tables", "temp"))}, CAST(floor((temp + final + tables) * {filters.STORAGE["free"]}::DOUBLE) AS BIGINT) AS free_bytes FROM r3"""
_BLOCKS = {
    "descriptive": "ds4_describe", "boxplots": "ds5_boxplot", "boxplots_nonzero": "ds5_boxplot", "boxplots_central": "ds6_boxplot_central95", "histograms": "ds7_histogram", "histograms_log1p": "ds7_histogram_log1p", "chart_readiness": "ds3_chart_readiness",
    "normality": "ds9_normality", "normality_log1p": "ds9_normality", "spearman": "ds12_spearman", "pearson_log1p": "ds13_pearson_log1p", "kendall_tau_b": "ds12_spearman", "rank_deltas": "rk8_rank_deltas", "largest_shifts": "rk9_largest_shifts", "top_overlap": "rk10_top_overlap",
    "pairwise": "ds12_spearman", "rank_summary": "ds16_rank_summary", "scorecard": "ds19_dependence", "findings": "ds18_findings", "finding_summary": "ds19_finding_summary", "conclusion": "ds20_conclusion", "warnings": "ds21_warnings",
}
_COUNTED = {v: f"n{i}" for i, v in enumerate(dict.fromkeys(_BLOCKS.values())) if v != "ds19_finding_summary"}
SQL["ds22_analysis"] = "WITH " + ", ".join(f"{n} AS MATERIALIZED (SELECT count(*) AS rows FROM ({SQL[v]}))" for v, n in _COUNTED.items()) + " " + " UNION ALL ".join(f"SELECT '{k}' AS \"table\", {f'rows FROM {_COUNTED[v]}' if v in _COUNTED else '1 AS rows'}" for k, v in _BLOCKS.items())
_COHORT = f"{STRICT}, s2 AS (SELECT * FROM s WHERE p >= 25), {long(['p', 'c', 'c_frac', 'h', 'g', 'i10'], 's2')}"
SQL["ch7_cohort_histograms"] = " UNION ALL ".join(f"SELECT *, '{scale}' AS scale FROM ({_histogram(v, rows=_COHORT)})" for scale, v in (("raw", "value"), ("log1p", "ln(1 + greatest(0, value))")))
SQL["ds24_outlier_rows"] = f"""WITH o AS ({SQL["ds5_boxplot_points"]}), w AS ({STRICT} SELECT author_id, author_display_name FROM s)
SELECT metric, author_id, author_display_name, value, rule, lower_fence, upper_fence FROM o JOIN w USING (author_id) WHERE rule = 'iqr_1_5'"""
_TAU_FEW = f"{STRICT}, k AS (SELECT author_id, {', '.join(FEW)} FROM s), pr AS (SELECT {_SIGNS(FEW)} FROM k x JOIN k y ON x.author_id < y.author_id) {_tau(PAIRS)}"
SQL["ds23_tidy_tables"] = " UNION ALL ".join(
    f"SELECT '{name}' AS \"table\", {left} AS \"left\", {right} AS \"right\", {cut} AS cut, {value} AS value FROM ({SQL.get(key, key)})"
    for name, key, left, right, cut, value in (
        ("chart_readiness", "ds3_chart_readiness", "metric", "NULL", "NULL", "CAST(boxplot = 'ok' AS DOUBLE)"), ("spearman", "ds12_spearman", "metric_a", "metric_b", "NULL", "value"), ("pearson_log1p", "ds13_pearson_log1p", "metric_a", "metric_b", "NULL", "value"),
        ("kendall_tau_b", _TAU_FEW, "metric_a", "metric_b", "NULL", "value"), ("top_overlap", "rk10_top_overlap", "metric_a", "metric_b", "cut", "jaccard"), ("rank_deltas", "rk8_rank_deltas", "metric", "NULL", "NULL", "p90_abs_delta"), ("rank_summary", "ds16_rank_summary", "metric", "NULL", "NULL", "top10_share"),
    )
)
