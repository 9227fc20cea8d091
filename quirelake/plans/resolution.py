"""Queries of entity resolution, matching and alias chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelake.functions.missing import doi_key, is_missing
from quirelake.operators import entities as E
from quirelake.operators import graph, matching
from quirelake.plans.base import MEMBERS, RECORDS, SQL_DOI as _SQL_DOI, entities, members, records, sql_missing, sql_plain_key, sql_title_key
from quirelake.plans.registering import Registry
from quirelake.session import table

register = Registry()
_COLS = ("doi", "arxiv_id", "paper_url", "pdf_url", "title", "authors", "venue", "year")


@register(f"WITH {RECORDS}, k AS (SELECT record_id, {_SQL_DOI} AS doi FROM r), g AS (SELECT doi, count(*) AS n, min(record_id) AS first_id FROM k WHERE doi IS NOT NULL GROUP BY doi) SELECT doi, n, first_id FROM g WHERE n > 1")
def er_doi_groups(spark, d):
    """The DOI groups that entities are merged by."""
    k = records(spark, d, "doi").withColumn("doi", doi_key(F.col("doi"))).where("doi IS NOT NULL")
    return k.groupBy("doi").agg(F.count("*").alias("n"), F.min("record_id").alias("first_id")).where("n > 1")


_URL_ID = "nullif(trim(regexp_extract({0}, '[?&]id=([^&#]*)', 1)), '')"
# Keys, groups by each key, and the closure of the links of those that merge: plain, and only for small tables.
_ER = f"""WITH RECURSIVE {RECORDS}, k AS (SELECT record_id, coalesce({_SQL_DOI}, '') AS doi, CASE WHEN {sql_missing('arxiv_id')} THEN '' ELSE regexp_replace(regexp_replace(lower(trim(arxiv_id)), '^arxiv:\\s*', ''), 'v[0-9]+$', '') END AS arxiv,
  coalesce(CASE WHEN contains(paper_url, 'openreview.net') THEN {_URL_ID.format('paper_url')} END, CASE WHEN contains(pdf_url, 'openreview.net') THEN {_URL_ID.format('pdf_url')} END, '') AS forum,
  {sql_plain_key('title')} AS title, CASE WHEN {sql_missing('authors')} THEN '' ELSE {sql_title_key('authors')} END AS people FROM r),
g AS (SELECT 'doi' AS kind, doi AS key, min(record_id) AS first, true AS fits, 1 AS phase FROM k WHERE doi <> '' GROUP BY 2 HAVING count(*) > 1 UNION ALL
  SELECT 'arxiv', arxiv, min(record_id), count(DISTINCT title) = 1 AND count(DISTINCT nullif(people, '')) <= 1, 2 FROM k WHERE arxiv <> '' GROUP BY 2 HAVING count(*) > 1 UNION ALL
  SELECT 'openreview', forum, min(record_id), count(DISTINCT title) = 1 AND count(DISTINCT nullif(people, '')) <= 1, 3 FROM k WHERE forum <> '' GROUP BY 2 HAVING count(*) > 1),
kk AS (SELECT record_id, 'doi' AS kind, doi AS key FROM k UNION ALL SELECT record_id, 'arxiv', arxiv FROM k UNION ALL SELECT record_id, 'openreview', forum FROM k),
l AS (SELECT g.first AS a, kk.record_id AS b, g.phase FROM g JOIN kk ON kk.kind = g.kind AND kk.key = g.key WHERE g.fits AND kk.record_id <> g.first),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), c AS (SELECT record_id AS node, record_id AS seen FROM k UNION SELECT c.node, e.b FROM c JOIN e ON e.a = c.seen),
p AS (SELECT node AS record_id, min(seen) AS component FROM c GROUP BY 1),
s AS (SELECT component, count(*) AS n, min(nullif(doi, '')) AS doi, min(record_id) AS first FROM p JOIN k USING (record_id) GROUP BY 1),
ph AS (SELECT component, min(phase) AS phase FROM l JOIN p ON p.record_id = l.a GROUP BY 1),
ms AS (SELECT record_id, 'ape_' || substr(sha256(coalesce('doi:' || s.doi, 'record:' || s.first)), 1, 24) AS entity_id, CASE WHEN s.n = 1 THEN 'singleton' ELSE ['doi', 'arxiv', 'openreview'][ph.phase] END AS match_method, CASE WHEN s.n = 1 THEN 'single' WHEN ph.phase = 1 THEN 'exact' ELSE 'high' END AS confidence FROM p JOIN s USING (component) LEFT JOIN ph USING (component))"""


@register(f"{_ER} SELECT record_id, entity_id, match_method, confidence FROM ms")
def er_memberships(spark, d):
    """Entities of all records, made anew."""
    return E.resolve(records(spark, d, *_COLS)).memberships


_CLASH = """(SELECT x.first AS left_id, y.first AS right_id, g.kind || '_conflict' AS reason, 'conflict' AS confidence FROM kinds x JOIN kinds y ON x.kind = y.kind AND x.key = y.key AND x.first < y.first JOIN g ON g.kind = x.kind AND g.key = x.key WHERE NOT g.fits
  UNION ALL SELECT z.first, kk.record_id, g.kind || '_conflict', 'conflict' FROM kinds z JOIN g ON g.kind = z.kind AND g.key = z.key JOIN kk ON kk.kind = z.kind AND kk.key = z.key JOIN k ON k.record_id = kk.record_id AND k.title = z.title AND k.people = z.people WHERE NOT g.fits AND kk.record_id <> z.first
  UNION ALL SELECT x.record_id, y.record_id, 'exact_title_authors', 'high' FROM k x JOIN k y ON x.title = y.title AND x.people = y.people AND x.record_id < y.record_id JOIN (SELECT title, people FROM k WHERE length(title) >= 24 AND length(people) >= 6 GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 10) t ON t.title = x.title AND t.people = x.people)"""


@register(f"{_ER}, kinds AS (SELECT kk.kind, kk.key, k.title, k.people, min(k.record_id) AS first FROM kk JOIN k USING (record_id) WHERE kk.key <> '' GROUP BY 1, 2, 3, 4), q AS {_CLASH} SELECT DISTINCT left_id, right_id, reason, q.confidence, 'review_' || substr(sha256(left_id || chr(0) || right_id || chr(0) || reason), 1, 24) AS candidate_id FROM q JOIN ms a ON a.record_id = q.left_id JOIN ms b ON b.record_id = q.right_id WHERE a.entity_id <> b.entity_id")
def er_candidates(spark, d):
    """Pairs for review."""
    return E.resolve(records(spark, d, *_COLS)).candidates


@register()
def er_stable_ids(spark, d):
    """Entities that keep the identities of the stored memberships: how many records kept their id, and aliases."""
    prior = members(spark, d).groupBy("record_id").agg(F.min("entity_id").alias("entity_id"))
    res = E.resolve(records(spark, d, *_COLS), prior)
    j = res.memberships.join(prior.withColumnRenamed("entity_id", "prior"), "record_id", "left")
    kept = j.agg(F.count("*").alias("n_records"), F.count_if(F.col("prior") == F.col("entity_id")).alias("n_kept"), F.count_if(F.col("prior").isNull()).alias("n_new"))
    return kept.join(res.aliases.agg(F.count("*").alias("n_aliases")))


@register(f"WITH {RECORDS}, {MEMBERS} SELECT entity_id, min(year) AS first_year, max(year) AS last_year, count(*) AS record_count, count(DISTINCT venue) AS venue_count, CASE WHEN count(*) > 1 THEN 'merged' ELSE 'single' END AS entity_status FROM m JOIN r ON r.record_id = m.record_id GROUP BY entity_id")
def er_entity_rows(spark, d):
    return E.entity_rows(members(spark, d), records(spark, d, "venue", "year"))


_AL = "a AS (SELECT lower(trim(alias_entity_id)) AS x, lower(trim(entity_id)) AS y FROM entity_aliases), al AS (SELECT x AS old, min(y) AS cur FROM a WHERE x <> y AND x <> '' AND y <> '' GROUP BY x)"


@register(f"WITH RECURSIVE {_AL}, f AS (SELECT old, cur FROM al UNION SELECT f.old, al.cur FROM f JOIN al ON al.old = f.cur), ends AS (SELECT f.old, f.cur FROM f LEFT JOIN al ON al.old = f.cur WHERE al.old IS NULL) SELECT count(*) AS n_chains, count(DISTINCT cur) AS n_ends FROM ends")
def er_alias_chains(spark, d):
    """Alias chains followed to their ends; those in a cycle have none."""
    low = table(spark, d, "entity_aliases").select(F.lower(F.trim("alias_entity_id")).alias("x"), F.lower(F.trim("entity_id")).alias("y")).where("x <> '' AND y <> ''")
    f = graph.followed_aliases(low, "x", "y").where("NOT in_cycle")
    return f.agg(F.count("*").alias("n_chains"), F.countDistinct("current").alias("n_ends"))


@register(f"WITH {_AL}, ids AS (SELECT DISTINCT x AS id FROM a WHERE x <> ''), c AS (SELECT DISTINCT entity_id FROM paper_entities) SELECT CASE WHEN c.entity_id IS NOT NULL THEN 'current' WHEN al.old IS NOT NULL THEN 'alias' ELSE 'missing' END AS status, count(*) AS n FROM ids LEFT JOIN c ON c.entity_id = ids.id LEFT JOIN al ON al.old = ids.id GROUP BY 1")
def er_alias_status(spark, d):
    """Whether an id is current, an alias or unknown."""
    low = table(spark, d, "entity_aliases").select(F.lower(F.trim("alias_entity_id")).alias("x"), F.lower(F.trim("entity_id")).alias("y")).where("x <> ''")
    al = low.where("y <> '' AND x <> y").select(F.col("x").alias("old"), F.col("y").alias("current"))
    return E.alias_status(low.select(F.col("x").alias("id")), entities(spark, d), al).groupBy("status").agg(F.count("*").alias("n"))


@register("WITH RECURSIVE p AS (SELECT lower(trim(alias_entity_id)) AS a, lower(trim(entity_id)) AS b FROM entity_aliases), e AS (SELECT a, b FROM p WHERE a <> '' AND b <> '' AND a <> b UNION SELECT b, a FROM p WHERE a <> '' AND b <> '' AND a <> b), c AS (SELECT a AS node, a AS seen FROM e UNION SELECT c.node, e.b FROM c JOIN e ON e.a = c.seen), g AS (SELECT node, min(seen) AS component FROM c GROUP BY 1) SELECT size, count(*) AS n FROM (SELECT component, count(*) AS size FROM g GROUP BY 1) GROUP BY 1")
def er_components(spark, d):
    """Components of the alias graph by star contraction: how many there are of each size."""
    low = table(spark, d, "entity_aliases").select(F.lower(F.trim("alias_entity_id")).alias("a"), F.lower(F.trim("entity_id")).alias("b")).where("a <> '' AND b <> ''")
    return graph.connected_components(low).groupBy("component").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


def _sides(spark, d, *columns):
    """Records of the first release and of the later ones, as two lists to reconcile."""
    r = records(spark, d, "release_id", *_COLS, "paper_id", *columns).withColumnRenamed("record_id", "id")
    first = table(spark, d, "data_releases").where("status = 'ready'").agg(F.min_by("release_id", "created_at").alias("first"))
    r = r.join(F.broadcast(first))  # one row
    return r.where("release_id <> first"), r.where("release_id = first")


_SQL_URL = lambda c: f"CASE WHEN NOT {sql_missing(c)} THEN regexp_replace(regexp_replace(regexp_replace(lower(trim({c})), '^https?://(?:www\\.)?', ''), '[?#].*$', ''), '/+$', '') END"
_FIRST = f"WITH {RECORDS}, f AS (SELECT arg_min(release_id, created_at) AS first FROM data_releases WHERE status = 'ready'), rr AS (SELECT record_id AS id, venue, year, release_id = (SELECT first FROM f) AS old, {_SQL_DOI} AS doi, {_SQL_URL('paper_url')} AS u1, {_SQL_URL('pdf_url')} AS u2, {sql_plain_key('title')} AS t FROM r WHERE release_id IS NOT NULL), k AS (SELECT DISTINCT id, venue, year, old, unnest(['doi:' || doi, 'url:' || u1, 'url:' || u2]) AS key FROM rr)"


@register(f"{_FIRST}, h AS (SELECT DISTINCT x.id AS ref_id, y.id AS local_id FROM k x JOIN k y ON x.key = y.key AND x.venue = y.venue AND x.year = y.year WHERE NOT x.old AND y.old), hn AS (SELECT ref_id, count(*) AS n, min(local_id) AS local_id FROM h GROUP BY 1), tn AS (SELECT venue, year, t, count(DISTINCT id) AS n, min(id) AS local_id FROM rr WHERE old AND t <> '' GROUP BY 1, 2, 3), j AS (SELECT rr.id, coalesce(hn.n, tn.n, 0) AS n, coalesce(hn.local_id, tn.local_id) AS local_id FROM rr LEFT JOIN hn ON hn.ref_id = rr.id LEFT JOIN tn ON tn.venue = rr.venue AND tn.year = rr.year AND tn.t = rr.t WHERE NOT rr.old), taken AS (SELECT local_id FROM h UNION SELECT local_id FROM j WHERE n = 1) SELECT CASE WHEN n = 1 THEN 'matched' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS status, count(*) AS n FROM j GROUP BY 1 UNION ALL SELECT 'local_only', count(*) FROM rr WHERE old AND id NOT IN (SELECT local_id FROM taken) HAVING count(*) > 0")
def match_reconcile(spark, d):
    """Later records against the first release of their venue and year, by status."""
    later, first = _sides(spark, d)
    return matching.reconcile(later, first, ["venue", "year"]).groupBy("status").agg(F.count("*").alias("n"))


_MERGE = f"""{_FIRST.replace("WITH r AS", "WITH RECURSIVE r AS")}, q AS (SELECT record_id AS id, venue || '|' || year AS block, release_id = (SELECT first FROM f) AS old, CASE WHEN NOT {sql_missing('paper_id')} THEN lower(trim(paper_id)) END AS pid, {_SQL_DOI} AS doi, {_SQL_URL('paper_url')} AS url, {sql_plain_key('title')} AS t FROM r WHERE release_id IS NOT NULL),
tg AS (SELECT id, block, 'pid:' || pid AS key FROM q WHERE old AND pid IS NOT NULL UNION SELECT id, block, 'doi:' || doi FROM q WHERE old AND doi IS NOT NULL UNION SELECT min(id), block, 'url:' || url FROM q WHERE old AND url IS NOT NULL GROUP BY block, url HAVING count(*) = 1),
nk AS (SELECT id, block, unnest(['pid:' || pid, 'doi:' || doi, 'url:' || url]) AS key FROM q WHERE NOT old), h0 AS (SELECT DISTINCT nk.id AS n, tg.id AS o FROM nk JOIN tg ON tg.block = nk.block AND tg.key = nk.key),
h1 AS (SELECT DISTINCT x.id AS n, y.id AS o FROM q x JOIN q y ON x.block = y.block AND x.t = y.t WHERE NOT x.old AND y.old AND x.t <> '' AND (x.doi IS NULL OR y.doi IS NULL OR x.doi = y.doi) AND x.id NOT IN (SELECT n FROM h0)),
h AS (SELECT n, 0 AS how, count(*) AS k, min(o) AS o FROM h0 GROUP BY 1 UNION ALL SELECT n, 1, count(*), min(o) FROM h1 GROUP BY 1), fr AS (SELECT * FROM q WHERE NOT old AND id NOT IN (SELECT n FROM h)),
one AS (SELECT block, t FROM fr WHERE t <> '' GROUP BY 1, 2 HAVING count(DISTINCT doi) <= 1), sh AS (SELECT id, block, unnest(['pid:' || pid, 'doi:' || doi]) AS key FROM fr UNION SELECT fr.id, fr.block, 't:' || fr.t FROM fr JOIN one ON one.block = fr.block AND one.t = fr.t),
an AS (SELECT block, key, min(id) AS a FROM sh WHERE key IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1), ed AS (SELECT an.a, sh.id AS b FROM sh JOIN an ON an.block = sh.block AND an.key = sh.key WHERE sh.id <> an.a), bo AS (SELECT a, b FROM ed UNION SELECT b, a FROM ed),
cl AS (SELECT a AS node, a AS seen FROM bo UNION SELECT cl.node, bo.b FROM cl JOIN bo ON bo.a = cl.seen), jo AS (SELECT node, min(seen) AS first FROM cl GROUP BY 1 HAVING min(seen) <> node)"""


@register(f"{_MERGE} SELECT n.id, CASE WHEN h.o IS NULL THEN CASE WHEN jo.first IS NULL THEN 'added' ELSE 'joined' END WHEN h.k > 1 THEN 'ambiguous_match' WHEN h.how = 0 AND n.t <> o.t THEN 'identifier_title_conflict' WHEN n.doi <> o.doi THEN 'title_doi_conflict' ELSE 'filled' END AS outcome, CASE WHEN h.k = 1 THEN h.o ELSE jo.first END AS old_id FROM q n LEFT JOIN h ON h.n = n.id LEFT JOIN q o ON o.id = h.o LEFT JOIN jo ON jo.node = n.id WHERE NOT n.old")
def match_merge_outcomes(spark, d):
    """What becomes of each record of the later releases when it is merged into the first one's lists."""
    later, first = _sides(spark, d)
    block = F.concat_ws("|", "venue", "year").alias("block")
    keep = ["id", "paper_id", "doi", "paper_url", "title", block]
    return matching.merge_outcomes(first.select(*keep), later.select(*keep))


@register()
def match_merged_lists(spark, d):
    """The first release's lists after the merge: rows, and how many have each field, by list."""
    later, first = _sides(spark, d, "list_status", *matching.ABSTRACT)
    block = F.concat_ws("|", "venue", "year").alias("block")
    keep = ["id", block, "paper_id", "title", "list_status", *matching.FILLED, *matching.ABSTRACT]
    m = matching.merge_incoming(first.select(*keep), later.select(*keep))
    return m.rows.groupBy("block").agg(F.count("*").alias("n"), *[F.count_if(~is_missing(F.col(c))).alias(c) for c in (*matching.FILLED, "abstract")])


@register(f"{_FIRST}, g AS (SELECT id, old, venue, year, t, unnest(['doi:' || doi, 'url:' || u1, 'url:' || u2]) AS key FROM rr), h AS (SELECT DISTINCT x.id AS ref_id, y.id AS local_id, x.venue = y.venue AND x.year = y.year AS inside FROM g x JOIN g y ON x.key = y.key WHERE NOT x.old AND y.old), h2 AS (SELECT * FROM h UNION ALL SELECT DISTINCT x.id, y.id, x.venue = y.venue AND x.year = y.year FROM rr x JOIN rr y ON x.t = y.t WHERE x.t <> '' AND NOT x.old AND y.old AND x.id NOT IN (SELECT ref_id FROM h)), n AS (SELECT ref_id, count(*) FILTER (WHERE inside) AS k, min(local_id) FILTER (WHERE inside) AS one FROM h2 GROUP BY 1) SELECT rr.id AS ref_id, CASE WHEN k = 1 THEN 'matched' WHEN k > 1 THEN 'ambiguous' WHEN k IS NOT NULL THEN 'existing_elsewhere' ELSE 'missing_candidate' END AS disposition, CASE WHEN k = 1 THEN one END AS local_id FROM rr LEFT JOIN n ON n.ref_id = rr.id WHERE NOT rr.old")
def match_dispositions(spark, d):
    """Later records against the first release: in their own list, only in another, or nowhere."""
    later, first = _sides(spark, d)
    return matching.dispositions(later, first, ["venue", "year"])


@register(f"{_FIRST}, x AS (SELECT DISTINCT venue, year, doi, old FROM rr WHERE doi IS NOT NULL) SELECT venue, year, doi, CASE WHEN old THEN 'local_only' ELSE 'foreign_only' END AS side, doi IN (SELECT doi FROM x y WHERE y.old <> x.old) AS elsewhere FROM x WHERE (venue, year, doi, NOT old) NOT IN (SELECT (venue, year, doi, old) FROM x)")
def match_doi_difference(spark, d):
    """DOIs that only the first release, or only the later ones, have in a venue and year, and whether the other has them elsewhere."""
    later, first = _sides(spark, d)
    return matching.doi_difference(first, later, ["venue", "year"])


@register(f"WITH {RECORDS}, f AS (SELECT arg_min(release_id, created_at) AS first FROM data_releases WHERE status = 'ready'), k AS (SELECT record_id, release_id = (SELECT first FROM f) AS old, {_SQL_DOI} AS doi, CASE WHEN NOT {sql_missing('arxiv_id')} THEN regexp_replace(regexp_replace(lower(trim(arxiv_id)), '^arxiv:\\s*', ''), 'v[0-9]+$', '') END AS arxiv, nullif({sql_plain_key('title')}, '') AS t, list_filter(list_transform(string_split(coalesce(authors, ''), ';'), lambda n: array_to_string(list_sort(regexp_extract_all(lower(n), '[\\p{{L}}]+')), ' ')), lambda n: n <> '') AS people, year FROM r WHERE release_id IS NOT NULL), c AS (SELECT x.record_id AS item_id, y.record_id AS other_id, 0 AS o, 'doi' AS how FROM k x JOIN k y ON x.doi = y.doi WHERE NOT x.old AND y.old UNION ALL SELECT x.record_id, y.record_id, 1, 'arxiv' FROM k x JOIN k y ON x.arxiv = y.arxiv WHERE NOT x.old AND y.old UNION ALL SELECT x.record_id, y.record_id, 2, 'title' FROM k x JOIN k y ON x.t = y.t WHERE NOT x.old AND y.old AND (list_has_any(x.people, y.people) OR x.year = y.year)) SELECT item_id, other_id, arg_min(how, o) AS how FROM c GROUP BY 1, 2")
def match_candidates(spark, d):
    """Records of the first release that a later one may be, under the first key that agrees."""
    later, first = _sides(spark, d)
    return matching.candidate_matches(later, first)


@register(f"{_ER}, kinds AS (SELECT kk.kind, kk.key, k.title, k.people, min(k.record_id) AS first FROM kk JOIN k USING (record_id) WHERE kk.key <> '' GROUP BY 1, 2, 3, 4), q AS {_CLASH}, z AS (SELECT DISTINCT left_id, right_id, reason, q.confidence FROM q JOIN ms a ON a.record_id = q.left_id JOIN ms b ON b.record_id = q.right_id WHERE a.entity_id <> b.entity_id) SELECT left_id, right_id, reason, z.confidence, x.title AS left_title, y.title AS right_title, x.venue AS left_venue, y.venue AS right_venue FROM z JOIN r x ON x.record_id = left_id JOIN r y ON y.record_id = right_id ORDER BY CASE z.confidence WHEN 'conflict' THEN 0 WHEN 'high' THEN 1 ELSE 2 END, left_id, right_id, reason LIMIT 25")
def er_candidate_page(spark, d):
    """The first page of pairs for review with both records, conflicts first."""
    c = E.resolve(records(spark, d, *_COLS)).candidates
    r = lambda side: records(spark, d, "title", "venue").select(F.col("record_id").alias(f"{side}_id"), F.col("title").alias(f"{side}_title"), F.col("venue").alias(f"{side}_venue"))
    first = F.when(F.col("confidence") == "conflict", 0).when(F.col("confidence") == "high", 1).otherwise(2)
    return c.join(r("left"), "left_id").join(r("right"), "right_id").select("left_id", "right_id", "reason", "confidence", "left_title", "right_title", "left_venue", "right_venue").orderBy(first, "left_id", "right_id", "reason").limit(25)


@register()
def match_fuzzy_titles(spark, d):
    """The best partner of later records by the ratio of their titles, of all of their venue and year."""
    later, first = _sides(spark, d)
    block = F.concat_ws("|", "venue", "year").alias("block")
    return matching.fuzzy_titles(later.select("id", "title", block), first.select("id", "title", block), "block", 0.9, 1, worded=False)


_ABS = f"WITH {RECORDS}, k AS (SELECT record_id, {_SQL_DOI} AS doi, abstract FROM r), have AS (SELECT doi, min(abstract) AS a, max(abstract) AS z FROM k WHERE doi IS NOT NULL AND NOT {sql_missing('abstract')} GROUP BY doi HAVING min(abstract) = max(abstract))"


@register(f"{_ABS} SELECT k.record_id, trim(h.a) AS found FROM k JOIN have h ON h.doi = k.doi WHERE {sql_missing('k.abstract')}")
def match_fill_abstracts(spark, d):
    """Missing abstracts that a record of the same DOI has, if all of those agree."""
    r = records(spark, d, "doi", "abstract")
    gone = r.where(is_missing(F.col("abstract"))).select("record_id", "doi")
    have = r.where(~is_missing(F.col("abstract"))).select(F.col("doi").alias("source_doi"), "abstract")
    out = matching.first_of_keys(gone, have, [("doi", doi_key(F.col("doi")), doi_key(F.col("source_doi")))], "abstract")
    return out.where("found_abstract IS NOT NULL").select("record_id", F.trim("found_abstract").alias("found"))


@register(f"WITH {RECORDS}, t AS (SELECT venue, year, lower(trim(title)) AS t, count(*) AS n, count(DISTINCT {_SQL_DOI}) AS dois FROM r WHERE NOT {sql_missing('title')} GROUP BY 1, 2, 3) SELECT venue, year, count(*) AS repeated_titles, sum(n) AS n, sum(dois) AS dois FROM t WHERE n > 1 GROUP BY venue, year")
def match_repeated_titles(spark, d):
    r = records(spark, d, "venue", "year", "title", "doi").where(~is_missing(F.col("title")))
    t = r.groupBy("venue", "year", F.lower(F.trim("title")).alias("t")).agg(F.count("*").alias("n"), F.countDistinct(doi_key(F.col("doi"))).alias("dois")).where("n > 1")
    return t.groupBy("venue", "year").agg(F.count("*").alias("repeated_titles"), F.sum("n").alias("n"), F.sum("dois").alias("dois"))


