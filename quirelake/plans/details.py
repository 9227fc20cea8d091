"""Detail pages as whole tables: every topic node, venue, area and direction at once, instead of one request each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quirelake.functions.columns import even_rate, rate, snippet
from quirelake.functions.missing import is_missing
from quirelake.operators import topics
from quirelake.plans.analyses import TAGS, TOPICS, _first_term, _TOPIC, _texts
from quirelake.plans.base import BASE, ENTITIES, LABELS, MEMBERS, RECORDS, base, entities, labels, members, records, sql_missing, sql_phrase
from quirelake.plans.registering import Registry
from quirelake.session import released, spool, table

register = Registry()
FAMILIES = sorted({t.family for t in TOPICS})


def top(rows: DataFrame, per: list[str], order: list[Column | str], most: int) -> DataFrame:
    """The first rows of each group in an order that leaves no ties."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*per).orderBy(*order))).where(F.col("place") <= most).drop("place")


def _nodes(spark) -> DataFrame:
    """topic_id and parent_topic_id of the tree, families as roots."""
    return spark.createDataFrame([(t.topic_id, t.family) for t in TOPICS] + [(f, "") for f in FAMILIES], "topic_id string, parent_topic_id string")


def _assigned(spark, d) -> DataFrame:
    """Each topic assignment with each node above it; the tree is configuration, so its closure is small."""
    a = topics.classify(_texts(spark, d), TOPICS).select("entity_id", "topic_id", "score", "role")
    return spool(a.join(F.broadcast(topics.ancestors(spark, _nodes(spark))), "topic_id").select("entity_id", "topic_id", "score", "role", F.col("ancestor_id").alias("node_id")), "topic-nodes")


_UP = f"{_TOPIC}, {MEMBERS}, up AS (SELECT *, topic_id AS node_id FROM asg UNION ALL SELECT *, family FROM asg), pr AS (SELECT * FROM up WHERE role = 'primary')"


@register(f"{_UP}, n AS (SELECT node_id, count(*) AS assignment_count, count(*) FILTER (WHERE role = 'extra') AS extra_count FROM up GROUP BY 1), es AS (SELECT node_id, count(DISTINCT entity_id) AS entity_count, round(avg(score), 2) AS average_score FROM pr GROUP BY 1), v AS (SELECT node_id, count(DISTINCT r.venue) AS venue_count, min(r.year) AS min_year, max(r.year) AS max_year, count(DISTINCT r.year) AS year_count, count(*) FILTER (WHERE list_status = 'final') AS final_records, count(*) FILTER (WHERE list_status = 'rolling') AS rolling_records FROM pr JOIN m ON m.entity_id = pr.entity_id JOIN r ON r.record_id = m.record_id GROUP BY 1) SELECT n.*, coalesce(entity_count, 0) AS entity_count, average_score, coalesce(venue_count, 0) AS venue_count, min_year, max_year, coalesce(year_count, 0) AS year_count, coalesce(final_records, 0) AS final_records, coalesce(rolling_records, 0) AS rolling_records, round_even(100.0 * coalesce(entity_count, 0) / (SELECT count(DISTINCT entity_id) FROM e_all), 1) AS coverage_rate FROM n LEFT JOIN es USING (node_id) LEFT JOIN v USING (node_id)".replace("e_all", "paper_entities"))
def topic_node_stats(spark, d):
    """Of each node its assignments, entities, score, venues, years and list states."""
    up = _assigned(spark, d)
    primary = up.where("role = 'primary'")
    n = up.groupBy("node_id").agg(F.count("*").alias("assignment_count"), F.count_if(F.col("role") == "extra").alias("extra_count"))
    e = primary.groupBy("node_id").agg(F.countDistinct("entity_id").alias("entity_count"), F.round(F.avg("score"), 2).alias("average_score"))
    seen = primary.select("node_id", "entity_id").join(members(spark, d), "entity_id").join(records(spark, d, "venue", "year", "list_status"), "record_id")
    v = seen.groupBy("node_id").agg(F.countDistinct("venue").alias("venue_count"), F.min("year").alias("min_year"), F.max("year").alias("max_year"), F.countDistinct("year").alias("year_count"), F.count_if(F.col("list_status") == "final").alias("final_records"), F.count_if(F.col("list_status") == "rolling").alias("rolling_records"))
    whole = entities(spark, d).agg(F.countDistinct("entity_id").alias("whole"))
    j = n.join(e, "node_id", "left").join(v, "node_id", "left").join(whole)
    return j.select(*[F.coalesce(c, F.lit(0)).alias(c) if c.endswith(("count", "records")) else F.col(c) for c in (*n.columns, *e.columns[1:], *v.columns[1:])], even_rate(F.coalesce("entity_count", F.lit(0)), F.col("whole"), 1).alias("coverage_rate"))


@register(f"{_UP}, c AS (SELECT node_id, r.venue, count(DISTINCT pr.entity_id) AS entity_count, count(DISTINCT r.record_id) AS record_count FROM pr JOIN m ON m.entity_id = pr.entity_id JOIN r ON r.record_id = m.record_id GROUP BY 1, 2), t AS (SELECT node_id, count(DISTINCT entity_id) AS total FROM pr GROUP BY 1) SELECT node_id, venue, entity_count, record_count, round_even(100.0 * entity_count / total, 1) AS share_rate FROM c JOIN t USING (node_id) QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY entity_count DESC, venue) <= 10")
def topic_node_venues(spark, d):
    """The ten venues with most entities of each node."""
    primary = _assigned(spark, d).where("role = 'primary'").select("node_id", "entity_id")
    total = primary.groupBy("node_id").agg(F.countDistinct("entity_id").alias("total"))
    seen = primary.join(members(spark, d), "entity_id").join(records(spark, d, "venue"), "record_id")
    c = seen.groupBy("node_id", "venue").agg(F.countDistinct("entity_id").alias("entity_count"), F.countDistinct("record_id").alias("record_count")).join(total, "node_id")
    return top(c.withColumn("share_rate", even_rate(F.col("entity_count"), F.col("total"), 1)), ["node_id"], [F.desc("entity_count"), "venue"], 10).drop("total")


@register(f"{_UP}, g AS (SELECT entity_id, 'diffusion' AS tag FROM x WHERE {_first_term('latent diffusion', 'flow matching')} IS NOT NULL UNION ALL SELECT entity_id, 'graph' FROM x WHERE {_first_term('graph transformers', 'message passing')} IS NOT NULL UNION ALL SELECT entity_id, 'retrieval' FROM x WHERE {_first_term('dual encoders', 'late interaction scoring')} IS NOT NULL) SELECT node_id, tag, count(DISTINCT g.entity_id) AS entity_count FROM g JOIN pr USING (entity_id) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY count(DISTINCT g.entity_id) DESC, tag) <= 10")
def topic_node_tags(spark, d):
    """The ten most frequent tags of the entities whose primary topic lies under each node."""
    primary = _assigned(spark, d).where("role = 'primary'").select("node_id", "entity_id")
    tags = topics.scan_tags(_texts(spark, d), TAGS).select("entity_id", "tag")
    c = tags.join(primary, "entity_id").groupBy("node_id", "tag").agg(F.countDistinct("entity_id").alias("entity_count"))
    return top(c, ["node_id"], [F.desc("entity_count"), "tag"], 10)


@register(f"{_UP}, ch AS (SELECT * FROM (VALUES ('t_diffusion', 'f_generation'), ('t_video', 'f_generation'), ('t_graph', 'f_graph'), ('t_retrieval', 'f_search'), ('t_diffusion', 't_diffusion'), ('t_video', 't_video'), ('t_graph', 't_graph'), ('t_retrieval', 't_retrieval')) c(topic_id, node_id)) SELECT ch.node_id, ch.topic_id, count(DISTINCT pr.entity_id) AS entity_count FROM ch LEFT JOIN pr ON pr.node_id = ch.topic_id GROUP BY 1, 2")
def topic_node_mix(spark, d):
    """The entities of the children of each node, zero included; a leaf has itself."""
    n = _nodes(spark)
    children = n.where("parent_topic_id <> ''").select("topic_id", F.col("parent_topic_id").alias("node_id"))
    leaves = n.join(n.select(F.col("parent_topic_id").alias("topic_id")), "topic_id", "left_anti").select("topic_id", F.col("topic_id").alias("node_id"))
    counts = _assigned(spark, d).where("role = 'primary'").groupBy(F.col("node_id").alias("topic_id")).agg(F.countDistinct("entity_id").alias("entity_count"))
    return children.unionAll(leaves).join(counts, "topic_id", "left").select("node_id", "topic_id", F.coalesce("entity_count", F.lit(0)).alias("entity_count"))


@register(f"{_TOPIC} SELECT (SELECT count(*) FROM x) AS papers, (SELECT count(DISTINCT entity_id) FROM asg) AS classified, (SELECT count(*) FROM (SELECT entity_id FROM asg GROUP BY 1 HAVING count(*) > 1)) AS extra_entities, round_even(100.0 * (SELECT count(DISTINCT entity_id) FROM asg) / (SELECT count(*) FROM x), 1) AS coverage_rate, round_even(100.0 * (SELECT count(*) FROM (SELECT entity_id FROM asg GROUP BY 1 HAVING count(*) > 1)) / greatest((SELECT count(DISTINCT entity_id) FROM asg), 1), 1) AS multi_label_rate")
def topic_coverage(spark, d):
    """How many papers have a topic, and how many of them several."""
    t = _texts(spark, d)
    n = topics.classify(t, TOPICS).groupBy("entity_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("classified"), F.count_if(F.col("n") > 1).alias("extra_entities"))
    return t.agg(F.count("*").alias("papers")).join(n).select("papers", "classified", "extra_entities", even_rate(F.col("classified"), F.col("papers"), 1).alias("coverage_rate"), even_rate(F.col("extra_entities"), F.greatest("classified", F.lit(1)), 1).alias("multi_label_rate"))


@register(f"{_UP}, k AS (SELECT DISTINCT r.venue, m.entity_id FROM m JOIN r ON r.record_id = m.record_id), w AS (SELECT venue, count(DISTINCT entity_id) AS total FROM k GROUP BY 1), f AS (SELECT entity_id, node_id FROM pr WHERE starts_with(node_id, 'f_')) SELECT k.venue, coalesce(node_id, '') AS family_id, count(DISTINCT k.entity_id) AS entity_count, any_value(total) AS total, round_even(100.0 * count(DISTINCT k.entity_id) / any_value(total), 1) AS share_rate FROM k JOIN w ON w.venue = k.venue LEFT JOIN f ON f.entity_id = k.entity_id GROUP BY 1, 2")
def venue_family_mix(spark, d):
    """Entities of each venue by family, with a bucket ('') for those of none; the buckets of a venue add up to its entities."""
    families = spark.createDataFrame([(f,) for f in FAMILIES], "node_id string")
    # the restriction to roots comes before the left joins, so that others still make the bucket
    of = _assigned(spark, d).where("role = 'primary'").join(F.broadcast(families), "node_id", "left_semi").select("entity_id", "node_id")
    k = members(spark, d).join(records(spark, d, "venue"), "record_id").select("venue", "entity_id").distinct()
    total = k.groupBy("venue").agg(F.count("*").alias("total"))
    g = k.join(of, "entity_id", "left").groupBy("venue", F.coalesce("node_id", F.lit("")).alias("family_id")).agg(F.countDistinct("entity_id").alias("entity_count"))
    return g.join(total, "venue").withColumn("share_rate", even_rate(F.col("entity_count"), F.col("total"), 1))


_V = f"WITH {RECORDS}, {MEMBERS}, {LABELS}"


@register(f"{_V}, j AS (SELECT r.venue, r.venue_type, r.year, r.list_status, r.record_id, {sql_missing('r.abstract')} AS bare, m.entity_id, l.area_id FROM r LEFT JOIN m ON m.record_id = r.record_id LEFT JOIN l ON l.entity_id = m.entity_id AND l.is_non_paper = 0), a AS (SELECT venue, area_id, count(DISTINCT entity_id) AS n FROM j WHERE area_id IS NOT NULL GROUP BY 1, 2), ta AS (SELECT venue, string_agg(area_id || ':' || n, ';' ORDER BY n DESC, area_id) AS top_areas FROM (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY venue ORDER BY n DESC, area_id) <= 5) GROUP BY 1), y AS (SELECT venue, string_agg(year || ':' || n, ';' ORDER BY year) AS years FROM (SELECT venue, year, count(DISTINCT entity_id) AS n FROM j GROUP BY 1, 2) GROUP BY 1) SELECT j.venue, min(venue_type) AS venue_type, count(DISTINCT record_id) AS record_count, count(DISTINCT entity_id) AS entity_count, count(DISTINCT year) AS year_count, count(DISTINCT record_id) FILTER (WHERE list_status = 'final') AS final_records, count(DISTINCT record_id) FILTER (WHERE list_status = 'rolling') AS rolling_records, count(DISTINCT record_id) FILTER (WHERE NOT bare) AS with_abstract, any_value(top_areas) AS top_areas, any_value(years) AS years FROM j LEFT JOIN ta ON ta.venue = j.venue LEFT JOIN y ON y.venue = j.venue GROUP BY j.venue")
def venue_detail(spark, d):
    """Of each venue its size, states, five largest areas and series of years."""
    r = records(spark, d, "venue", "venue_type", "year", "list_status", "abstract").withColumn("bare", is_missing(F.col("abstract"))).drop("abstract")
    one = F.col("record_id")
    area = labels(spark, d).where("is_non_paper = 0").select("entity_id", "area_id")
    j = spool(r.join(members(spark, d), "record_id", "left").join(area, "entity_id", "left"), "venue-detail")
    g = j.groupBy("venue").agg(F.min("venue_type").alias("venue_type"), F.countDistinct("record_id").alias("record_count"), F.countDistinct("entity_id").alias("entity_count"), F.countDistinct("year").alias("year_count"), *[F.countDistinct(F.when(c, one)).alias(n) for n, c in (("final_records", F.col("list_status") == "final"), ("rolling_records", F.col("list_status") == "rolling"), ("with_abstract", ~F.col("bare")))])
    areas = top(j.where("area_id IS NOT NULL").groupBy("venue", "area_id").agg(F.countDistinct("entity_id").alias("n")), ["venue"], [F.desc("n"), "area_id"], 5)
    areas = areas.groupBy("venue").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "area_id", "n"))).alias("a")).select("venue", F.array_join(F.transform("a", lambda x: F.concat_ws(":", x["area_id"], x["n"])), ";").alias("top_areas"))
    years = j.groupBy("venue", "year").agg(F.countDistinct("entity_id").alias("n")).groupBy("venue").agg(F.array_sort(F.collect_list(F.struct("year", "n"))).alias("a")).select("venue", F.array_join(F.transform("a", lambda x: F.concat_ws(":", x["year"], x["n"])), ";").alias("years"))
    return g.join(areas, "venue", "left").join(years, "venue", "left")


_AREA = f"WITH {RECORDS}, m AS (SELECT DISTINCT record_id, entity_id, is_canonical FROM entity_memberships), {LABELS}, s AS (SELECT l.area_id, l.direction_id, l.entity_id, r.venue, r.year, r.list_status FROM l JOIN m ON m.entity_id = l.entity_id AND m.is_canonical = 1 JOIN r ON r.record_id = m.record_id WHERE l.is_non_paper = 0), w AS (SELECT count(*) AS total FROM l WHERE is_non_paper = 0)"
_STATS = "count(DISTINCT entity_id) AS entity_count, count(DISTINCT venue) AS venue_count, min(year) AS min_year, max(year) AS max_year, max(year) - min(year) + 1 AS year_count, count(*) FILTER (WHERE list_status = 'final') AS final_records, count(*) FILTER (WHERE list_status = 'rolling') AS rolling_records, round_even(100.0 * count(DISTINCT entity_id) / (SELECT total FROM w), 1) AS coverage_rate"


def _canonical(spark, d) -> DataFrame:
    area = labels(spark, d).where("is_non_paper = 0")
    return area.join(members(spark, d, "is_canonical").where("is_canonical = 1"), "entity_id").join(records(spark, d, "venue", "year", "list_status"), "record_id")


def node_stats(rows: DataFrame, per: list[str], total: DataFrame) -> DataFrame:
    """Numbers of the nodes of an area tree; a span of years counts all years in it. total has one row."""
    g = rows.groupBy(*per).agg(F.countDistinct("entity_id").alias("entity_count"), F.countDistinct("venue").alias("venue_count"), F.min("year").alias("min_year"), F.max("year").alias("max_year"), (F.max("year") - F.min("year") + 1).alias("year_count"), F.count_if(F.col("list_status") == "final").alias("final_records"), F.count_if(F.col("list_status") == "rolling").alias("rolling_records"))
    return g.join(total).withColumn("coverage_rate", even_rate(F.col("entity_count"), F.col("total"), 1)).drop("total")


def _papers(spark, d) -> DataFrame:
    return labels(spark, d).where("is_non_paper = 0").agg(F.count("*").alias("total"))


@register(f"{_AREA} SELECT area_id, {_STATS} FROM s GROUP BY 1")
def area_node_stats(spark, d):
    return node_stats(_canonical(spark, d), ["area_id"], _papers(spark, d))


@register(f"{_AREA} SELECT area_id, direction_id, {_STATS} FROM s WHERE direction_id IS NOT NULL GROUP BY 1, 2")
def direction_node_stats(spark, d):
    return node_stats(_canonical(spark, d).where("direction_id IS NOT NULL"), ["area_id", "direction_id"], _papers(spark, d))


@register(f"WITH x AS (SELECT entity_id, min(area_id) AS area_id, min(nullif(area_secondary, '')) AS direction_id, max(is_non_paper) AS is_non_paper, max(CASE WHEN lower(trim(confidence)) = 'low' THEN 1 ELSE 0 END) AS needs_review FROM entity_area_assignments WHERE entity_id IS NOT NULL GROUP BY 1) SELECT a.area_id, d.direction_id, count(x.entity_id) AS entity_count, coalesce(sum(needs_review), 0) AS needs_review_count FROM (SELECT DISTINCT area_id FROM area_definitions) a CROSS JOIN (SELECT DISTINCT direction_id FROM x WHERE direction_id IS NOT NULL) d LEFT JOIN x ON x.area_id = a.area_id AND x.direction_id = d.direction_id AND x.is_non_paper = 0 GROUP BY 1, 2 HAVING count(x.entity_id) > 0 OR a.area_id = d.direction_id")
def area_directions(spark, d):
    """The directions of each area with their papers and those that need review; an area's own direction is kept without any."""
    t = table(spark, d, "entity_area_assignments").where("entity_id IS NOT NULL")
    x = t.groupBy("entity_id").agg(F.min("area_id").alias("area_id"), F.min(F.expr("nullif(area_secondary, '')")).alias("direction_id"), F.max("is_non_paper").alias("is_non_paper"), F.max(F.when(F.lower(F.trim("confidence")) == "low", 1).otherwise(0)).alias("needs_review"))
    areas = table(spark, d, "area_definitions").select("area_id").distinct()
    g = x.where("is_non_paper = 0 AND direction_id IS NOT NULL").join(areas, "area_id", "left_semi").groupBy("area_id", "direction_id").agg(F.count("*").alias("entity_count"), F.sum("needs_review").alias("needs_review_count"))
    own = areas.join(x.select(F.col("direction_id").alias("area_id")).distinct(), "area_id", "left_semi").select("area_id", F.col("area_id").alias("direction_id"))
    return g.join(own, ["area_id", "direction_id"], "full").select("area_id", "direction_id", F.coalesce("entity_count", F.lit(0)).alias("entity_count"), F.coalesce("needs_review_count", F.lit(0)).alias("needs_review_count"))


#: Values a filter of the browser may have; others are left out without a word.
BROWSED = {"venue_type": ("conference", "journal", "preprint"), "list_status": ("final", "rolling"), "has_abstract": ("yes", "no")}


def browsed(rows: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Rows that meet the presence and enumeration filters; a filter with another value has no effect."""
    for key, values in BROWSED.items():
        value = filters.get(key, "")
        if value not in values:
            continue
        if key == "has_abstract":
            rows = rows.where(~is_missing(F.col("abstract")) if value == "yes" else is_missing(F.col("abstract")))
        else:
            rows = rows.where(F.col(key) == value)
    for key in ("venue", "year"):
        if filters.get(key):
            rows = rows.where(F.col(key) == filters[key])
    return rows


_BROWSE = f"WITH {RECORDS}, {MEMBERS}, x AS (SELECT r.record_id, m.entity_id, r.venue, r.year, r.title FROM r JOIN m ON m.record_id = r.record_id WHERE r.venue_type = 'journal' AND NOT {sql_missing('r.abstract')})"


def _browse(spark, d, filters: dict[str, str], *columns: str) -> DataFrame:
    return browsed(records(spark, d, "venue", "venue_type", "year", "list_status", "abstract", *columns), filters).join(members(spark, d), "record_id")


@register(f"{_BROWSE} SELECT DISTINCT entity_id FROM x")
def browse_entity_ids(spark, d):
    """All entities of journals with an abstract; the unknown list status changes nothing."""
    return _browse(spark, d, {"venue_type": "journal", "has_abstract": "yes", "list_status": "whatever"}).select("entity_id").distinct()


@register(f"{_BROWSE} SELECT entity_id, record_id, venue, year, title FROM x ORDER BY year DESC, title NULLS FIRST, record_id LIMIT 25 OFFSET 25")
def browse_page(spark, d):
    """The second page of them, newest first."""
    x = _browse(spark, d, {"venue_type": "journal", "has_abstract": "yes"}, "title")
    return x.select("entity_id", "record_id", "venue", "year", "title").orderBy(F.desc("year"), F.asc_nulls_first("title"), "record_id").offset(25).limit(25)


@register(f"{_UP}, k AS (SELECT DISTINCT m.entity_id, r.venue, r.year, r.venue_type FROM m JOIN r ON r.record_id = m.record_id), f AS (SELECT 'venue' AS facet, venue AS value, count(DISTINCT entity_id) AS n FROM k GROUP BY 2 UNION ALL SELECT 'year', CAST(year AS VARCHAR), count(DISTINCT entity_id) FROM k GROUP BY 2 UNION ALL SELECT 'venue_type', venue_type, count(DISTINCT entity_id) FROM k GROUP BY 2 UNION ALL SELECT 'topic', node_id, count(DISTINCT entity_id) FROM pr GROUP BY 2) SELECT * FROM f WHERE value IS NOT NULL")
def browse_facets(spark, d):
    """Distinct entities by venue, year, type and topic, topics rolled up their tree."""
    k = members(spark, d).join(records(spark, d, "venue", "year", "venue_type"), "record_id")
    long = k.select("entity_id", F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in ("venue", "year", "venue_type")])).alias("f")).select("entity_id", "f.facet", "f.value")
    topic = _assigned(spark, d).where("role = 'primary'").select("entity_id", F.lit("topic").alias("facet"), F.col("node_id").alias("value"))
    return long.unionAll(topic).where("value IS NOT NULL").groupBy("facet", "value").agg(F.countDistinct("entity_id").alias("n"))


@register(f"WITH {RECORDS}, {ENTITIES}, {LABELS} SELECT e.entity_id, CASE WHEN l.entity_id IS NULL THEN 'unlabelled' WHEN l.is_non_paper = 1 THEN 'non_paper' WHEN l.direction_id IS NULL THEN 'area_only' ELSE 'full' END AS state, r.title FROM e LEFT JOIN l ON l.entity_id = e.entity_id LEFT JOIN r ON r.record_id = e.canonical_record_id ORDER BY CASE state WHEN 'area_only' THEN 0 WHEN 'unlabelled' THEN 1 WHEN 'non_paper' THEN 2 ELSE 3 END, r.title NULLS FIRST, e.entity_id LIMIT 50")
def review_page(spark, d):
    """The first fifty entities in the order in which they need work: a fixed priority of their states."""
    l = labels(spark, d)
    j = entities(spark, d, "canonical_record_id").join(l.withColumn("labelled", F.lit(True)), "entity_id", "left").join(records(spark, d, "title").withColumnRenamed("record_id", "canonical_record_id"), "canonical_record_id", "left")
    state = F.when(F.col("labelled").isNull(), "unlabelled").when(F.col("is_non_paper") == 1, "non_paper").when(F.col("direction_id").isNull(), "area_only").otherwise("full")
    return j.select("entity_id", state.alias("state"), "title").orderBy(priority("state", ("area_only", "unlabelled", "non_paper")), F.asc_nulls_first("title"), "entity_id").limit(50)


def priority(column: str, values: tuple[str, ...]) -> Column:
    """The place of a value in a fixed order; others come last."""
    out = F.lit(len(values))
    for i, v in reversed(list(enumerate(values))):
        out = F.when(F.col(column) == v, i).otherwise(out)
    return out


@register(f"WITH {MEMBERS} SELECT match_method, confidence, count(DISTINCT entity_id) AS n_entities, count(*) AS n_rows FROM m GROUP BY 1, 2 UNION ALL SELECT 'candidate', decision_status, count(DISTINCT entity_id), count(*) FROM m GROUP BY 2")
def entity_quality(spark, d):
    """Match methods, and what was decided on candidates, in one table."""
    m = members(spark, d, "match_method", "confidence", "decision_status")
    g = lambda a, b: m.groupBy(a.alias("match_method"), b.alias("confidence")).agg(F.countDistinct("entity_id").alias("n_entities"), F.count("*").alias("n_rows"))
    return g(F.col("match_method"), F.col("confidence")).unionAll(g(F.lit("candidate"), F.col("decision_status")))


@register(f"WITH {BASE}, d AS (SELECT DISTINCT area_id, name_en FROM area_definitions) SELECT d.area_id, d.name_en, coalesce((SELECT string_agg(DISTINCT direction_id, ';' ORDER BY direction_id) FROM b WHERE b.area_id = d.area_id), '') AS directions FROM d")
def list_facets(spark, d):
    """The areas with their directions, sorted."""
    n = base(spark, d).groupBy("area_id").agg(F.array_join(F.array_sort(F.collect_set("direction_id")), ";").alias("directions"))
    return table(spark, d, "area_definitions").select("area_id", "name_en").distinct().join(n, "area_id", "left").select("area_id", "name_en", F.coalesce("directions", F.lit("")).alias("directions"))


@register(f"WITH {BASE} SELECT venue, year, area_id, count(*) AS n FROM b WHERE direction_id IN (SELECT area_id FROM area_definitions WHERE lower(name_en) LIKE '%learning%' OR lower(name_zh) LIKE '%learning%') GROUP BY 1, 2, 3")
def cap_named_directions(spark, d):
    """Papers of the directions whose names have a word."""
    from quirelake.plans.capabilities import selected

    return selected(spark, d, {"direction_names": ["learning"]}).groupBy("venue", "year", "area_id").agg(F.count("*").alias("n"))


@register(f"WITH {RECORDS}, f AS (SELECT source_file, first_value(venue) OVER w AS v0, first_value(year) OVER w AS y0, venue, year FROM r WINDOW w AS (PARTITION BY source_file ORDER BY record_id)) SELECT source_file, count(*) AS n_rows, count(*) FILTER (WHERE venue <> v0 OR year <> y0) AS n_other FROM f GROUP BY 1 HAVING count(*) FILTER (WHERE venue <> v0 OR year <> y0) > 0")
def quality_rows_of_other_lists(spark, d):
    """Rows of a source file whose venue or year is not that of its first row; the first is found by an aggregate, not a window."""
    r = records(spark, d, "source_file", "venue", "year")
    first = r.groupBy("source_file").agg(F.min_by(F.struct("venue", "year"), "record_id").alias("f"))
    j = r.join(first, "source_file").withColumn("other", (F.col("venue") != F.col("f.venue")) | (F.col("year") != F.col("f.year")))
    return j.groupBy("source_file").agg(F.count("*").alias("n_rows"), F.count_if("other").alias("n_other")).where("n_other > 0")


@register(f"WITH {RECORDS}, {ENTITIES}, m AS (SELECT DISTINCT record_id, entity_id, is_canonical FROM entity_memberships), {LABELS}, u AS (SELECT 'records_without_entity' AS rule, count(*) AS n FROM r WHERE record_id NOT IN (SELECT record_id FROM m WHERE record_id IS NOT NULL) UNION ALL SELECT 'entities_without_record', count(*) FROM e WHERE canonical_record_id IS NULL OR canonical_record_id NOT IN (SELECT record_id FROM r) UNION ALL SELECT 'entities_without_members', count(*) FROM (SELECT DISTINCT entity_id FROM e) WHERE entity_id NOT IN (SELECT entity_id FROM m WHERE entity_id IS NOT NULL) UNION ALL SELECT 'several_canonical', count(*) FROM (SELECT entity_id FROM m WHERE is_canonical = 1 GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'labels_without_entity', count(*) FROM l WHERE entity_id NOT IN (SELECT entity_id FROM e) UNION ALL SELECT 'labels_without_area', count(*) FROM l WHERE is_non_paper = 0 AND area_id IS NULL UNION ALL SELECT 'unknown_area', count(*) FROM l WHERE area_id NOT IN (SELECT area_id FROM area_definitions) UNION ALL SELECT 'record_in_several_entities', count(*) FROM (SELECT record_id FROM m GROUP BY 1 HAVING count(DISTINCT entity_id) > 1)) SELECT rule, n, n > 0 AS failed FROM u")
def quality_gate(spark, d):
    """The eight counts that must be zero before a release is published."""
    r, e, m, l = records(spark, d), entities(spark, d, "canonical_record_id"), members(spark, d, "is_canonical"), labels(spark, d)
    n = lambda df, rule: df.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
    parts = [
        n(r.join(m, "record_id", "left_anti"), "records_without_entity"),
        n(e.join(r, F.col("canonical_record_id") == r.record_id, "left_anti"), "entities_without_record"),
        n(e.select("entity_id").distinct().join(m, "entity_id", "left_anti"), "entities_without_members"),
        n(m.where("is_canonical = 1").groupBy("entity_id").count().where("count > 1"), "several_canonical"),
        n(l.join(e, "entity_id", "left_anti"), "labels_without_entity"),
        n(l.where("is_non_paper = 0 AND area_id IS NULL"), "labels_without_area"),
        n(l.where("area_id IS NOT NULL").join(table(spark, d, "area_definitions").select("area_id"), "area_id", "left_anti"), "unknown_area"),
        n(m.groupBy("record_id").agg(F.countDistinct("entity_id").alias("k")).where("k > 1"), "record_in_several_entities"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.withColumn("failed", F.col("n") > 0)
