"""Techniques and vulnerabilities behind the hits, the flow between tactics, and who works like that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelake.operators.detect import haystack, truncate, truncate_sql
from tracelake.operators.timeline import numbered
from tracelake.rules import severity
from tracelake.rules.actors import ACTORS, PARTED, TOOLS
from tracelake.rules.cves import CVES, UNKNOWN
from tracelake.rules.signatures import SIGNATURES, TACTICS
from tracelake.rx import Rx, any_of, any_sql, gate, quoted

EVIDENCES, SNIPPET = 12, 160
SEP = " | "


def tactic_order(tactic: Column) -> Column:
    out = F.lit(99)
    for t, (_, k) in TACTICS.items():
        out = F.when(tactic == t, k).otherwise(out)
    return out


def tactic_name(tactic: Column) -> Column:
    out = tactic
    for t, (name, _) in TACTICS.items():
        out = F.when(tactic == t, name).otherwise(out)
    return out


def tactic_order_sql(tactic: str) -> str:
    return f"CASE {tactic} " + " ".join(f"WHEN '{t}' THEN {k}" for t, (_, k) in TACTICS.items()) + " ELSE 99 END"


def tactic_name_sql(tactic: str) -> str:
    return f"CASE {tactic} " + " ".join(f"WHEN '{t}' THEN '{n}'" for t, (n, _) in TACTICS.items()) + f" ELSE {tactic} END"


def _description(no: Column) -> Column:
    return F.get(F.array(*[F.lit(s.description) for s in SIGNATURES]), no)


def evidence_of(text: Column) -> Column:
    """A line's number and the start of what it says."""
    return F.concat(F.lit("L"), F.col("line_number").cast("string"), F.lit(": "), truncate(F.trim(text), SNIPPET))


def _first_of_each(rows: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """The first n rows of each key; Spark cuts groups before the shuffle too."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("nth__", F.row_number().over(w)).where(F.col("nth__") <= n)


def techniques(hits: DataFrame) -> DataFrame:
    """One row a technique: its first hit's description, worst severity, linked CVEs in order of appearance, first evidences."""
    seen = hits.groupBy("technique_id", "technique", "tactic_id", "rule_no", "severity", "cves").agg(F.count("*").alias("n"), F.min("line_number").alias("first"))
    order = F.struct("first", "rule_no")
    per = seen.groupBy("technique_id").agg(
        F.min_by("technique", order).alias("technique"),
        F.min_by("tactic_id", order).alias("tactic_id"),
        F.min_by("rule_no", order).alias("rule_no"),
        severity.worst(F.col("severity")).alias("severity"),
        F.sum("n").alias("hits"),
        F.array_sort(F.collect_list(F.struct("first", "rule_no", "cves"))).alias("rules"),
    )  # a group has a row for each rule at most
    cves = F.array_distinct(F.filter(F.flatten(F.transform("rules", lambda r: F.split(r["cves"], ","))), lambda c: c != ""))
    first = _first_of_each(hits.select("technique_id", "line_number", "rule_no", evidence_of(haystack()).alias("e")), "technique_id", ["line_number", "rule_no"], EVIDENCES)
    evidence = first.groupBy("technique_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth__", "e"))), lambda x: x["e"]), SEP).alias("evidence"))
    out = per.join(evidence, "technique_id")
    return out.select("technique_id", "technique", "tactic_id", tactic_name(F.col("tactic_id")).alias("tactic"), tactic_order(F.col("tactic_id")).alias("tactic_order"), _description(F.col("rule_no")).alias("description"), "severity", F.array_join(cves, ",").alias("cves"), "hits", "evidence", F.concat(F.lit("https://attack.mitre.org/techniques/"), F.replace("technique_id", F.lit("."), F.lit("/")), F.lit("/")).alias("url"))


def techniques_sql(hits: str) -> str:
    descriptions = ", ".join(quoted(s.description) for s in SIGNATURES)
    text = "trim(coalesce(nullif(raw, ''), message))"
    return f"""SELECT technique_id, technique, tactic_id, {tactic_name_sql('tactic_id')} AS tactic, {tactic_order_sql('tactic_id')} AS tactic_order, [{descriptions}][rule_no + 1] AS description, severity,
        array_to_string(list_filter([c FOR c IN string_split(cves, ',')], lambda c, i: c <> '' AND NOT list_contains(string_split(cves, ',')[:i - 1], c)), ',') AS cves, hits, evidence,
        'https://attack.mitre.org/techniques/' || replace(technique_id, '.', '/') || '/' AS url FROM (
      SELECT technique_id, arg_min(technique, (line_number, rule_no)) AS technique, arg_min(tactic_id, (line_number, rule_no)) AS tactic_id, arg_min(rule_no, (line_number, rule_no)) AS rule_no,
        {severity.worst_sql('severity')} AS severity, string_agg(CASE WHEN first_of_rule THEN cves END, ',' ORDER BY line_number, rule_no) AS cves, count(*)::BIGINT AS hits,
        string_agg(CASE WHEN nth <= {EVIDENCES} THEN 'L' || line_number || ': ' || {truncate_sql(text, SNIPPET)} END, '{SEP}' ORDER BY line_number, rule_no) AS evidence
      FROM (SELECT *, row_number() OVER (PARTITION BY technique_id ORDER BY line_number, rule_no) AS nth, row_number() OVER (PARTITION BY rule_no ORDER BY line_number) = 1 AS first_of_rule FROM ({hits})) GROUP BY technique_id)"""


def cve_hits(entries: DataFrame) -> DataFrame:
    """(line_number, cve, evidence) of lines that match a vulnerability's own patterns."""
    rows = entries.select("line_number", haystack().alias("text__"), F.lower(haystack()).alias("lower__"))
    return rows.select("line_number", evidence_of(F.col("text__")).alias("evidence"), F.explode(named_cves(F.col("text__"), F.col("lower__"))).alias("cve"))


def named_cves(text: Column, lower: Column) -> Column:
    """The vulnerabilities whose own patterns occur in a text."""
    ids = F.array_compact(F.array(*[F.when(any_of(text, c.patterns, lower), F.lit(c.id)) for c in CVES if c.patterns]))
    some = gate(lower, tuple(p for c in CVES for p in c.patterns))
    return ids if some is None else F.when(some, ids).otherwise(F.array().cast("array<string>"))


def cve_links(techniques_: DataFrame) -> DataFrame:
    """(cve, technique_id) pairs of the signatures that hit."""
    return techniques_.where("cves <> ''").select(F.explode(F.split("cves", ",")).alias("cve"), "technique_id")


def _cve_facts(cve: Column) -> list[Column]:
    facts = {"description": (UNKNOWN[0], lambda c: c.description), "cvss": (UNKNOWN[1], lambda c: c.cvss), "severity": (UNKNOWN[2], lambda c: c.severity)}
    out = []
    for name, (other, get) in facts.items():
        value = F.lit(other)
        for c in CVES:
            value = F.when(cve == c.id, F.lit(get(c))).otherwise(value)
        out.append(value.alias(name))
    return out


def cve_evidence(hits: DataFrame) -> DataFrame:
    """(cve, evidence, first_line, lines) of every different evidence of a vulnerability, given `cve_hits`."""
    return hits.groupBy("cve", F.regexp_replace("evidence", "^L[0-9]+: ", "").alias("evidence")).agg(F.min("line_number").alias("first_line"), F.count("*").alias("lines"))


def cve_evidence_sql(entries: str) -> str:
    return f"SELECT cve, regexp_replace(evidence, '^L[0-9]+: ', '') AS evidence, min(line_number) AS first_line, count(*)::BIGINT AS lines FROM ({cve_hits_sql(entries)}) GROUP BY ALL"


def cves(hits: DataFrame, techniques_: DataFrame, ioc_rows: DataFrame) -> DataFrame:
    """One row a vulnerability that is matched (`cve_hits`), named, or linked to a technique that hit; `cve_evidence` has all its evidence."""
    named = ioc_rows.where("type = 'cve'").groupBy(F.upper("value").alias("cve")).agg(F.sum("count").alias("named"))
    matched = hits.groupBy("cve").agg(F.count("*").alias("matched"), F.min_by("evidence", "line_number").alias("first_evidence"))
    linked = cve_links(techniques_).groupBy("cve").agg(F.array_join(F.array_sort(F.collect_set("technique_id")), ",").alias("techniques"))
    out = matched.join(named, "cve", "full").join(linked, "cve", "full")
    return out.select("cve", *_cve_facts(F.col("cve")), F.coalesce("named", F.lit(0)).cast("long").alias("named"), F.coalesce("matched", F.lit(0)).cast("long").alias("matched"), F.coalesce("techniques", F.lit("")).alias("techniques"), F.coalesce("first_evidence", F.lit("")).alias("first_evidence"), F.concat(F.lit("https://nvd.nist.gov/vuln/detail/"), "cve").alias("url"))


def cve_hits_sql(entries: str) -> str:
    text = "coalesce(nullif(raw, ''), message)"
    tests = ", ".join(f"CASE WHEN {any_sql(text, c.patterns)} THEN '{c.id}' END" for c in CVES if c.patterns)
    return f"SELECT line_number, 'L' || line_number || ': ' || {truncate_sql(f'trim({text})', SNIPPET)} AS evidence, unnest(list_filter([{tests}], lambda x: x IS NOT NULL)) AS cve FROM ({entries})"


def cves_sql(entries: str, techniques_: str, ioc_rows: str) -> str:
    known = ", ".join(f"('{c.id}', {quoted(c.description)}, {c.cvss}::DOUBLE, '{c.severity}')" for c in CVES)
    return f"""WITH named AS (SELECT upper(value) AS cve, sum(count)::BIGINT AS named FROM ({ioc_rows}) WHERE type = 'cve' GROUP BY 1),
      matched AS (SELECT cve, count(*)::BIGINT AS matched, arg_min(evidence, line_number) AS first_evidence FROM ({cve_hits_sql(entries)}) GROUP BY 1),
      linked AS (SELECT cve, string_agg(DISTINCT technique_id, ',' ORDER BY technique_id) AS techniques FROM (SELECT technique_id, unnest(string_split(cves, ',')) AS cve FROM ({techniques_}) WHERE cves <> '') GROUP BY 1)
      SELECT cve, coalesce(k.description, {quoted(UNKNOWN[0])}) AS description, coalesce(k.cvss, {UNKNOWN[1]}::DOUBLE) AS cvss, coalesce(k.severity, '{UNKNOWN[2]}') AS severity,
        coalesce(named, 0)::BIGINT AS named, coalesce(matched, 0)::BIGINT AS matched, coalesce(techniques, '') AS techniques, coalesce(first_evidence, '') AS first_evidence, 'https://nvd.nist.gov/vuln/detail/' || cve AS url
      FROM matched FULL JOIN named USING (cve) FULL JOIN linked USING (cve) LEFT JOIN (VALUES {known}) AS k(cve, description, cvss, severity) USING (cve)"""


def flow_nodes(techniques_: DataFrame) -> DataFrame:
    """One node a tactic, in order: its techniques and worst severity."""
    per = techniques_.groupBy("tactic_id").agg(F.array_join(F.array_sort(F.collect_list("technique_id")), ", ").alias("techniques"), severity.worst(F.col("severity")).alias("severity"), F.sum("hits").alias("hits"))
    place = F.row_number().over(Window.orderBy(tactic_order(F.col("tactic_id"))))  # a row for each tactic
    return per.select(place.alias("step"), "tactic_id", tactic_name(F.col("tactic_id")).alias("tactic"), "techniques", "severity", "hits")


def flow_nodes_sql(techniques_: str) -> str:
    return f"""SELECT row_number() OVER (ORDER BY {tactic_order_sql('tactic_id')})::INT AS step, tactic_id, {tactic_name_sql('tactic_id')} AS tactic, techniques, severity, hits FROM (
      SELECT tactic_id, string_agg(technique_id, ', ' ORDER BY technique_id) AS techniques, {severity.worst_sql('severity')} AS severity, sum(hits)::BIGINT AS hits FROM ({techniques_}) GROUP BY 1)"""


def flow_edges(nodes: DataFrame) -> DataFrame:
    """Each node with the one after it."""
    w = Window.orderBy("step")  # a row for each tactic
    return nodes.select("step", F.col("tactic_id").alias("from_tactic"), F.lead("tactic_id").over(w).alias("to_tactic")).where("to_tactic is not null")


#: Characters at the end and at the start of a row that a name over several rows can take up.
REACH = 24
_STARTS = Rx("(?:" + "|".join(sorted({w for words in PARTED for w in words[:-1]})) + ")$")
_LASTS = Rx("^(?:" + "|".join(sorted({w for words in PARTED for w in words[1:]})) + ")")


def _tools(text: Column, lower: Column) -> Column:
    """Keys of the tools that a text names."""
    return F.array_compact(F.array(*[F.when(any_of(text, (rx,), lower), F.lit(k)) for k, rx, _ in TOOLS]))


def tools_named(text_rows: DataFrame, text: str, order: list[str] | None = None) -> DataFrame:
    """(tool, rows) of the tools that a text column names anywhere.

    With `order`, columns that name a row, a name may also begin at the end of a row and go on in the one or two
    rows after it; it counts for the row where it begins. Only rows that end or start with a part of such
    a name are looked at for it, and rows are numbered (by ranges of their order) only if there are any.
    """
    rows = text_rows.select(F.col(text).alias("text__"), F.lower(text).alias("lower__"))
    named = rows.select(F.explode(_tools(F.col("text__"), F.col("lower__"))).alias("tool"))
    if order is not None:
        edge = F.col(text).rlike(_STARTS.java) | F.col(text).rlike(_LASTS.java)
        if text_rows.where(F.col(text).rlike(_STARTS.java)).take(1):
            named = named.unionByName(_over_rows(numbered(text_rows.select(*order, text), order, "place").where(edge).select("place", F.col(text).alias("said"))))
    return named.groupBy("tool").agg(F.count("*").alias("rows"))


def _over_rows(edges: DataFrame) -> DataFrame:
    """(tool) for each row (place, said) where a name begins that the rows after it finish, and that isn't in the row itself."""
    ends = edges.where(F.col("said").rlike(_STARTS.java)).select("place", F.right("said", F.lit(REACH)).alias("said"))
    after = [edges.where(F.col("said").rlike(_LASTS.java)).select((F.col("place") - k).alias("place"), F.left("said", F.lit(REACH)).alias(f"said{k}"), (F.length("said") <= REACH).alias(f"whole{k}")) for k in (1, 2)]
    met = ends.join(after[0], "place").join(after[1], "place", "left").withColumn("said2", F.when(F.col("whole1"), F.col("said2")))
    joined = F.concat_ws("\n", "said", "said1", "said2")
    # What stands in one of the rows alone counts there.
    alone = [_tools(F.col(c), F.lower(c)) for c in ("said", "said1", "said2")]
    over = F.array_except(_tools(joined, F.lower(joined)), F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in alone]))
    return met.select(F.explode(over).alias("tool"))


def tools_sql(source: str, text: str, order: str | None = None) -> str:
    tests = lambda t: f"list_filter([{', '.join(f"CASE WHEN {any_sql(t, (rx,))} THEN '{k}' END" for k, rx, _ in TOOLS)}], lambda x: x IS NOT NULL)"
    named = f"SELECT unnest({tests(text)}) AS tool FROM ({source})"
    if order:
        rows = f"SELECT {text} AS s0, lead({text}) OVER (ORDER BY {order}) AS s1, lead({text}, 2) OVER (ORDER BY {order}) AS s2 FROM ({source})"
        cut = f"SELECT *, right(s0, {REACH}) AS a, left(s1, {REACH}) AS b, CASE WHEN length(s1) <= {REACH} AND regexp_matches(s2, {quoted(_LASTS.re2)}) THEN left(s2, {REACH}) END AS c FROM ({rows}) WHERE regexp_matches(s0, {quoted(_STARTS.re2)}) AND regexp_matches(s1, {quoted(_LASTS.re2)})"
        joined = f"SELECT *, concat_ws(chr(10), a, b, c) AS j FROM ({cut})"
        named += f" UNION ALL SELECT unnest(list_filter({tests('j')}, lambda x: NOT list_contains(list_concat({tests('a')}, {tests('b')}, {tests('c')}), x))) AS tool FROM ({joined})"
    return f"SELECT tool, count(*)::BIGINT AS rows FROM ({named}) GROUP BY tool"


def attribution(techniques_: DataFrame, tools: DataFrame, top: int = 6) -> DataFrame:
    """Groups that share two indicators at least with what was found, most alike first.

    The profiles are a fixed table; what they join with has a row for each technique or tool.
    """
    spark = techniques_.sparkSession
    profiles = [(a, kind, x) for a, t, s in ACTORS for kind, names in (("technique", t), ("tool", s)) for x in names]
    rare = [k for k, _, commodity in TOOLS if not commodity]
    profile = spark.createDataFrame(profiles, "actor string, kind string, name string")
    own = techniques_.select(F.explode(F.array("technique_id", F.substring_index("technique_id", ".", 1))).alias("name")).distinct().withColumn("kind", F.lit("technique"))
    found = own.unionByName(tools.select(F.col("tool").alias("name"), F.lit("tool").alias("kind")))
    met = profile.join(found, ["kind", "name"])
    named = lambda kind: F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("name")))), ",")
    per = met.groupBy("actor").agg(F.count_if(F.col("kind") == "tool").alias("n_tools"), F.count_if(F.col("kind") == "technique").alias("n_techniques"), F.count_if(F.col("name").isin(rare)).alias("n_rare"), named("tool").alias("tools"), named("technique").alias("techniques"))
    per = per.where(F.col("n_tools") + F.col("n_techniques") >= 2)
    confidence = F.when((F.col("n_rare") > 0) & (F.col("n_tools") >= 2), "high").when((F.col("n_tools") >= 3) | (F.col("n_rare") > 0), "medium").otherwise("low")
    score = F.round(F.least(F.lit(1.0), (3 * F.col("n_tools") + F.col("n_techniques")) / F.lit(12.0)), 2)
    return per.select("actor", score.alias("score"), confidence.alias("confidence"), "n_tools", "n_techniques", "tools", "techniques").orderBy(F.desc("score"), F.desc("n_tools"), "actor").limit(top)


def attribution_sql(techniques_: str, tools: str, top: int = 6) -> str:
    rows = ", ".join(f"('{a}', '{kind}', '{x}')" for a, t, s in ACTORS for kind, names in (("technique", t), ("tool", s)) for x in names)
    rare = ", ".join(f"'{k}'" for k, _, commodity in TOOLS if not commodity)
    return f"""WITH found AS (SELECT DISTINCT 'technique' AS kind, unnest([technique_id, string_split(technique_id, '.')[1]]) AS name FROM ({techniques_}) UNION ALL SELECT 'tool', tool FROM ({tools})),
      per AS (SELECT actor, count(*) FILTER (kind = 'tool') AS n_tools, count(*) FILTER (kind = 'technique') AS n_techniques, count(*) FILTER (name IN ({rare})) AS n_rare,
        coalesce(string_agg(CASE WHEN kind = 'tool' THEN name END, ',' ORDER BY name), '') AS tools, coalesce(string_agg(CASE WHEN kind = 'technique' THEN name END, ',' ORDER BY name), '') AS techniques
        FROM (VALUES {rows}) AS p(actor, kind, name) JOIN found USING (kind, name) GROUP BY actor)
      SELECT actor, round(least(1.0, (3 * n_tools + n_techniques) / 12.0::DOUBLE), 2)::DOUBLE AS score,
        CASE WHEN n_rare > 0 AND n_tools >= 2 THEN 'high' WHEN n_tools >= 3 OR n_rare > 0 THEN 'medium' ELSE 'low' END AS confidence, n_tools, n_techniques, tools, techniques
      FROM per WHERE n_tools + n_techniques >= 2 ORDER BY score DESC, n_tools DESC, actor LIMIT {top}"""
