"""All queries outside the training-data subpackage, and the SQL that gives the same rows.

Telemetry operators run on the events table: a user is a file, the event type a message type, event_id
the order and ts the time; GPS, barometer and estimator points are derived from types and values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import numbers
from lodestrata.operators import analyses, checks, explore, features, flatten, learning, relations, roles, telemetry, versions
from lodestrata.plans import corpus, profile, revisions
from lodestrata.sources import connector, logscan, places
from lodestrata.streaming import live

#: Files of a batch of a stream that takes all that there are.
ALL = 1 << 30
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- fields of sources ----------------------------------------------------------------------------


def event_leaves(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"), F.when(F.col("event_type") != "error", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("ts"))
    return flatten.flatten_columns(events.withColumn("id", F.col("event_id")), "event_id").withColumnRenamed("path", "path")


LEAVES = """leaves AS (
  SELECT event_id seq, unnest(['user_id','event_type','cents','ts','id']) path,
         unnest([user_id::varchar, event_type, round(value*100)::bigint::varchar,
                 CASE WHEN event_type <> 'error' THEN strftime(ts,'%Y-%m-%d %H:%M:%S') END, event_id::varchar]) "value"
  FROM events)"""
ENTITIES = """leaves AS (
  SELECT c_custkey seq, unnest(['c_name','c_mktsegment','c_nationkey','c_acctbal']) path,
         unnest([c_name, c_mktsegment, c_nationkey::varchar, round(c_acctbal*100)::bigint::varchar]) "value" FROM customer
  UNION ALL SELECT page_id, 'url', url FROM pages
  UNION ALL SELECT doc_id, unnest(['lang','source']), unnest([lang, source]) FROM documents
  UNION ALL SELECT event_id, 'seen_at', strftime(ts,'%Y-%m-%d %H:%M:%S') FROM events)"""


def entity_leaves(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey", F.round(F.col("c_acctbal") * 100).cast("long").alias("c_acctbal"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    seen = table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("seen_at"))
    parts = (customer, "c_custkey"), (table(spark, sf_dir, "pages").select("page_id", "url"), "page_id"), (docs, "doc_id"), (seen, "event_id")
    return reduce(DataFrame.unionByName, (flatten.flatten_columns(*p) for p in parts))


@query(f"WITH {LEAVES} SELECT path, count(*) n, count(\"value\") filled, min(\"value\") lo, max(\"value\") hi FROM leaves GROUP BY path")
def flatten_events_paths(spark, sf_dir):
    return event_leaves(spark, sf_dir).groupBy("path").agg(F.count("*").alias("n"), F.count("value").alias("filled"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query("SELECT event_id seq, 'k' path, json_extract_string(props, '$.k') \"value\" FROM events")
def flatten_json_props(spark, sf_dir):
    return flatten.flatten_json(table(spark, sf_dir, "events"), "event_id", "props")


@query("""WITH n AS (SELECT event_id seq, event_id % 5 k, user_id, event_type, round(value*100)::bigint cents FROM events)
 SELECT seq, unnest(['user.id','user.kind','list.0','list.1.flag','list.1.none','list.2.0.0','price','list.1.text']) path,
  unnest([user_id::varchar, event_type, cents::varchar, CASE WHEN k = 0 THEN 'True' ELSE 'False' END, NULL, seq::varchar, (cents // 100)::varchar || '.5', '"1e5" é']) "value" FROM n
 UNION ALL SELECT seq, 'big', '100000.0' FROM n WHERE k = 1 UNION ALL SELECT seq, 'user.id.x', 'first' FROM n WHERE k = 2""")
def flatten_json_nested(spark, sf_dir):
    """Nested objects and arrays, nulls, empty ones, numbers of all forms, paths that collide, and broken and null texts."""
    i, k = F.col("event_id"), F.col("event_id") % 5
    cents = F.round(F.col("value") * 100).cast("long")

    def filled(form, *columns):
        """The form with the columns in place of its percent signs, by concat, which takes less time than format_string."""
        shown = (F.coalesce(c.cast("string"), F.lit("null")) for c in columns)
        return F.concat(*(c for pair in zip(map(F.lit, form.split("%")), [*shown, F.lit("")]) for c in pair))

    head = filled('{"user": {"id": %, "kind": "%"}, "list": [%, {"flag": %, "none": null, "empty": {}, "text": "\\"1e5\\" é"}, [[%]], []], "price": %.50', F.col("user_id"), F.col("event_type"), cents, F.when(k == 0, "true").otherwise("false"), i, F.floor(cents / 100).cast("long"))
    tail = F.when(k == 1, ', "big": 1e5}').otherwise("}")
    tail = F.when(k == 2, filled(', "user.id.x": "first", "user": {"id": %, "kind": "%", "id.x": "last"}}', F.col("user_id"), F.col("event_type"))).otherwise(tail)
    events = table(spark, sf_dir, "events").select(i.alias("event_id"), F.concat(head, tail).alias("text"))
    broken = table(spark, sf_dir, "events").select((-i).alias("event_id"), F.when(k == 0, "{broken").when(k == 1, "[{}, []]").alias("text"))
    return flatten.flatten_json(events.union(broken), "event_id", "text")


@query("""WITH l AS (SELECT event_id seq, unnest([event_type, 'always', 'd' || length(event_id::varchar)]) path, unnest([CASE WHEN user_id % 3 <> 0 THEN user_id END, event_id, user_id % 10]) v FROM events),
 f AS (SELECT path, min(seq) mn, count(v) filled, count(DISTINCT v) u FROM l GROUP BY path)
 SELECT path, (SELECT count(*) FROM events WHERE event_id >= f.mn) sample_count, (SELECT count(*) FROM events WHERE event_id >= f.mn) - filled null_count, u unique_count FROM f""")
def field_counts(spark, sf_dir):
    """Paths that come first at the start (types, always) and late (numbers of so many digits) in the events."""
    events, seq = table(spark, sf_dir, "events"), F.col("event_id")
    leaf = lambda path, value: F.struct(path.alias("path"), value.cast("string").alias("value"))
    leaves = F.array(leaf(F.col("event_type"), F.when(F.col("user_id") % 3 != 0, F.col("user_id"))), leaf(F.lit("always"), seq), leaf(F.concat(F.lit("d"), F.length(seq.cast("string"))), F.col("user_id") % 10))
    return flatten.field_counts(events.select(seq.alias("seq"), F.explode(leaves).alias("l")).select("seq", "l.*"), events, "event_id")


def _features_sql(leaves: str) -> str:
    ratios = ", ".join(f"""round(coalesce(sum(length(regexp_replace("value",'[^{c}]','','g'))),0)/greatest(sum(length("value")),1)::double,6) {k}_ratio""" for k, c in (("alpha", r"\p{L}"), ("numeric", r"\p{Nd}"), ("hex", "0-9a-fA-F"), ("uppercase", r"\p{Lu}"), ("whitespace", r"\s")))
    has = ", ".join(f"""round(sum(CASE WHEN contains("value",'{s}') THEN 1 ELSE 0 END)/greatest(count("value"),1)::double,6) {k}_ratio""" for k, s in features.SEPARATORS.items())
    number = features.NUMBER
    return f"""WITH {leaves},
 ch AS (SELECT path, unnest(string_split("value",'')) ch FROM leaves), cc AS (SELECT path, ch, count(*) k FROM ch WHERE ch <> '' GROUP BY ALL),
 en AS (SELECT path, sum(-(k/t)*log2(k/t)) e FROM (SELECT path, k, sum(k) OVER (PARTITION BY path)::double t FROM cc) GROUP BY path),
 sh AS (SELECT path, max(k) modal FROM (SELECT path, regexp_replace(regexp_replace("value",'\\p{{L}}','A','g'),'\\p{{Nd}}','N','g') s, count(*) k FROM leaves WHERE "value" IS NOT NULL GROUP BY ALL) GROUP BY path),
 a AS (SELECT path, count(*)::bigint sample_count, (count(*)-count("value"))::bigint null_count, count(DISTINCT "value")::bigint unique_count,
  round(least(avg(length("value"))/1000,1),6) mean_length, round(least(quantile_disc(length("value"),0.5 ORDER BY length("value") DESC)/1000,1),6) median_length,
  round(least(stddev_pop(length("value"))/1000,1),6) stddev_length, round(least(min(length("value"))/1000,1),6) min_length, round(least(max(length("value"))/1000,1),6) max_length,
  {ratios}, round((sum(length("value"))-sum(length(regexp_replace("value",'[^\\p{{L}}\\p{{Nd}}\\s]','','g'))))/greatest(sum(length("value")),1)::double,6) punct_ratio, {has},
  round(least(sum(length(regexp_replace("value",'[^.\\-:/_@]','','g')))/(6.0*count("value"))::double/10,1),6) mean_separator_count,
  round(sum(CASE WHEN regexp_matches("value",'{number}') THEN 1 ELSE 0 END)/count("value")::double,6) is_numeric_ratio,
  round(least(coalesce(max(CASE WHEN regexp_matches("value",'{number}') THEN try_cast("value" AS double) END)-min(CASE WHEN regexp_matches("value",'{number}') THEN try_cast("value" AS double) END),0)/100000,1),6) numeric_range_span,
  round(sum(CASE WHEN regexp_matches("value",'{number}') AND regexp_matches("value",'^-*[0-9]+$') THEN 1 ELSE 0 END)/count("value")::double,6) is_integer_ratio,
  round(count(DISTINCT "value")/count("value")::double,6) cardinality_ratio, round((count(*)-count("value"))/count(*)::double,6) null_ratio,
  round(least(var_pop(length("value"))/(avg(length("value"))*avg(length("value"))+1e-10),1),6) length_variance_ratio,
  CASE WHEN min(length("value"))=max(length("value")) AND count("value")>1 THEN 1.0::double ELSE 0.0::double END has_fixed_length, count("value") n
  FROM leaves GROUP BY path)
 SELECT a.* EXCLUDE (n), round(least(e/7,1),6) entropy, round(modal/n::double,6) format_consistency FROM a JOIN en USING (path) JOIN sh USING (path)"""


def _rounded(found: DataFrame) -> DataFrame:
    return found.select("path", "sample_count", "null_count", "unique_count", *(F.round(c, 6).alias(c) for c in features.NAMES))


@query(_features_sql(LEAVES))
def field_feature_matrix(spark, sf_dir):
    return _rounded(features.field_features(event_leaves(spark, sf_dir)))


@query(_features_sql(ENTITIES))
def entity_feature_matrix(spark, sf_dir):
    return _rounded(features.field_features(entity_leaves(spark, sf_dir)))


#: Shares of the first ten distinct values of a path that fit each format, in SQL.
SAMPLED = """tn AS (SELECT path, "value" v FROM (SELECT path, "value", row_number() OVER (PARTITION BY path ORDER BY "value") r FROM (SELECT DISTINCT path, "value" FROM leaves WHERE "value" IS NOT NULL)) WHERE r <= 10),
 sm AS (SELECT path, avg(regexp_matches(v,'^\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}$')::int) ip4, avg(regexp_matches(v,'^([0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{0,4}$')::int) ip6, avg(regexp_matches(v,'^([0-9a-fA-F]{2}[:\\-]){5}[0-9a-fA-F]{2}$')::int) mac,
  avg(regexp_matches(v,'^([0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64})$')::int) hx, mode(length(v)) hl, avg(regexp_matches(v,'^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$')::int) uu,
  avg(regexp_matches(v,'^https?://')::int) ur, avg(regexp_matches(v,'^[a-zA-Z][a-zA-Z0-9\\-]*(\\.[a-zA-Z][a-zA-Z0-9\\-]*)+$')::int) fq, avg(regexp_matches(v,'\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}:\\d{2}')::int) iso FROM tn GROUP BY path)"""
HINT = "CASE WHEN ip4>0.8 THEN 'ipv4' WHEN ip6>0.6 THEN 'ipv6' WHEN mac>0.6 THEN 'mac' WHEN hx>0.7 THEN CASE hl WHEN 32 THEN 'hash_md5' WHEN 40 THEN 'hash_sha1' ELSE 'hash_sha256' END WHEN uu>0.6 THEN 'uuid' WHEN ur>0.5 THEN 'url' WHEN fq>0.5 THEN 'fqdn' END"
ROLES = f"""{SAMPLED}, ra AS (SELECT path, count(*) total, count("value") n, count(DISTINCT "value") u, count(DISTINCT "value")/count("value")::double card, avg(length("value")) len, var_pop(length("value"))/(avg(length("value"))**2+1e-10) lvr,
  min(length("value"))=max(length("value")) fixed, sum(length(regexp_replace("value",'[^\\p{{L}}]','','g')))/sum(length("value"))::double alpha, sum(length(regexp_replace("value",'[^\\p{{Nd}}]','','g')))/sum(length("value"))::double num,
  sum(length(regexp_replace("value",'[^\\s]','','g')))/sum(length("value"))::double ws, avg(regexp_matches("value",'^[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?$')::int) isnum,
  avg(contains("value",':')::int) colon, avg(contains("value",'-')::int) dash, avg(contains("value",'.')::int)+avg(contains("value",'-')::int)+avg(contains("value",':')::int)+avg(contains("value",'_')::int)+avg(contains("value",'@')::int) marks FROM leaves GROUP BY path),
 rc AS (SELECT path, unnest(string_split("value",'')) ch FROM leaves), re AS (SELECT path, sum(-(k/t)*log2(k/t))/7 e FROM (SELECT path, k, sum(k) OVER (PARTITION BY path)::double t FROM (SELECT path, ch, count(*) k FROM rc WHERE ch<>'' GROUP BY ALL)) GROUP BY path),
 rs AS (SELECT ra.*, sm.* EXCLUDE (path), (CASE WHEN card>0.1 AND card<0.95 THEN 0.3::double WHEN card>=0.95 AND u>5 THEN 0.2::double ELSE 0 END)+(CASE WHEN marks>0.3 THEN 0.2::double ELSE 0 END)+(CASE WHEN lvr<0.3 THEN 0.15::double ELSE 0 END)+(CASE WHEN fixed AND n>1 THEN 0.2::double ELSE 0 END)+(CASE WHEN len>5 AND len<100 THEN 0.15::double ELSE 0 END)+(CASE WHEN alpha>0.2 AND num>0.1 THEN 0.1::double ELSE 0 END)+(CASE WHEN e>0.4 THEN 0.1::double ELSE 0 END) score FROM ra JOIN re USING (path) JOIN sm USING (path)),
 rr AS (SELECT *, CASE WHEN n=0 THEN 'unknown' WHEN colon>0.8 AND dash>0.5 AND len>15 AND len<35 AND iso>0.7 THEN 'temporal' WHEN isnum>0.9 THEN 'metric' WHEN (u<=3 AND n>=5) OR (card<0.1 AND n>=10) THEN 'enum' WHEN len>50 AND alpha>0.7 AND ws>0.05 THEN 'text' WHEN score>=0.5 THEN 'entity' ELSE 'unknown' END AS "role" FROM rs)"""


@query(f"""WITH {ENTITIES}, {ROLES} SELECT path, "role", CASE WHEN "role"='entity' THEN {HINT} END type_hint FROM rr""")
def role_classification(spark, sf_dir):
    return roles.classified(features.field_features(entity_leaves(spark, sf_dir))).select("path", "role", "type_hint")


@query(f"""WITH m AS (SELECT event_id, event_type, md5(event_id::varchar) h FROM events), leaves AS (SELECT event_type path, CASE event_type WHEN 'click' THEN (event_id%256) || '.' || (event_id*3%256) || '.' || (event_id*7%256) || '.' || (event_id*11%256) WHEN 'view' THEN h
  WHEN 'error' THEN h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] WHEN 'signup' THEN 'h' || h[1:6] || '.example.org' ELSE h[1:2] || '-' || h[3:4] || '-' || h[5:6] || '-' || h[7:8] || '-' || h[9:10] || '-' || h[11:12] END "value" FROM m), {SAMPLED} SELECT path, {HINT} hint FROM sm""")
def type_hints(spark, sf_dir):
    h = F.md5(F.col("event_id").cast("string"))
    ip = F.concat_ws(".", *((F.col("event_id") * k % 256).cast("string") for k in (1, 3, 7, 11)))
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    mac = F.concat_ws("-", *(F.substring(h, 2 * i + 1, 2) for i in range(6)))
    value = F.when(F.col("event_type") == "click", ip).when(F.col("event_type") == "view", h).when(F.col("event_type") == "error", uuid).when(F.col("event_type") == "signup", F.concat(F.lit("h"), F.substring(h, 1, 6), F.lit(".example.org"))).otherwise(mac)
    leaves = table(spark, sf_dir, "events").select(F.col("event_type").alias("path"), value.alias("value"))
    return features.field_features(leaves).select("path", roles.type_hint(F.col("samples")).alias("hint"))


PRESENCE = "p AS (SELECT DISTINCT event_id // 4 seq, event_type path FROM events), n AS (SELECT count(DISTINCT event_id // 4) n FROM events), k AS (SELECT path, count(*) k FROM p GROUP BY path), b AS (SELECT x.path path_a, y.path path_b, count(*) c FROM p x JOIN p y ON x.seq=y.seq AND x.path<y.path GROUP BY ALL), j AS (SELECT path_a, path_b, c, ka.k ka, kb.k kb, n.n n FROM b JOIN k ka ON ka.path=path_a JOIN k kb ON kb.path=path_b, n)"
MI = " + ".join(f"(CASE WHEN ({q})>0 THEN ({q})/n::double*log2(({q})::double*n/(({x})::double*({y}))) ELSE 0 END)" for q, x, y in (("c", "ka", "kb"), ("ka-c", "ka", "n-kb"), ("kb-c", "n-ka", "kb"), ("n-ka-kb+c", "n-ka", "n-kb")))


def _presence(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 4).alias("seq"), F.col("event_type").alias("path"), F.lit("x").alias("value"))


@query(f"WITH {PRESENCE} SELECT path_a, path_b, c both_count, round(greatest({MI},0),6) mutual_information FROM j")
def presence_mi(spark, sf_dir):
    leaves = _presence(spark, sf_dir)
    n = leaves.select("seq").distinct().count()
    return relations.co_occurrence(leaves, n).withColumn("mutual_information", F.round("mutual_information", 6))


@query(f"WITH {PRESENCE} SELECT path_a, path_b, c both_count, round(greatest({MI},0),6) mutual_information FROM j")
def presence_mi_stream(spark, sf_dir):
    """As presence_mi, from counts that a stream keeps over several batches of events."""
    folder, out, place = (places.scratch(spark, n) for n in ("events", "pairs", "place"))
    events = _presence(spark, sf_dir).groupBy("seq").agg(F.collect_list("path").alias("paths"))
    events.repartition(3, "seq").write.parquet(folder)
    stream = live.tail(spark, folder, events.schema, files=1)
    q = live.watch_pairs(stream, F.col("paths"), lambda table, _: table.write.mode("overwrite").parquet(out), place).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).withColumn("mutual_information", F.round("mutual_information", 6))


@query(f"""WITH {PRESENCE}, h AS (SELECT * FROM (VALUES ('click','ipv4'),('view','fqdn'),('error','url'),('signup','ipv6'),('purchase',NULL)) t(path,hint)), e AS (SELECT j.*, greatest({MI},0) mi, a.hint hint_a, b.hint hint_b FROM j JOIN h a ON a.path=path_a JOIN h b ON b.path=path_b)
 SELECT path_a, path_b, c both_count, CASE WHEN least(hint_a,hint_b)='ipv4' AND greatest(hint_a,hint_b)='ipv6' THEN 'COMMUNICATES_WITH' WHEN least(hint_a,hint_b)='fqdn' AND greatest(hint_a,hint_b) IN ('ipv4','ipv6') AND hint_a IS NOT NULL AND hint_b IS NOT NULL THEN 'RESOLVES_TO' WHEN greatest(hint_a,hint_b)='url' AND least(hint_a,hint_b) IN ('ipv4','ipv6') AND hint_a IS NOT NULL AND hint_b IS NOT NULL THEN 'HOSTS' ELSE 'CO_OCCURS_WITH' END relationship_type FROM e WHERE mi >= 0.001""")
def relationship_edges(spark, sf_dir):
    leaves = _presence(spark, sf_dir)
    hint = F.create_map(*(F.lit(x) for kv in (("click", "ipv4"), ("view", "fqdn"), ("error", "url"), ("signup", "ipv6")) for x in kv))
    fields = leaves.select("path").distinct().select("path", F.lit("entity").alias("role"), hint[F.col("path")].alias("type_hint"))
    return relations.edges(leaves, fields, leaves.select("seq").distinct().count(), 0.001).select("path_a", "path_b", "both_count", "relationship_type")


@query(f"WITH {LEAVES} SELECT substr(sha256('[\"' || string_agg(DISTINCT path, '\", \"' ORDER BY path) || '\"]'),1,16) fingerprint FROM leaves WHERE seq < 10")
def schema_fingerprint(spark, sf_dir):
    return profile.fingerprint(event_leaves(spark, sf_dir))


@query(f"""WITH {ENTITIES}, {ROLES}, nm AS (SELECT (SELECT count(DISTINCT seq) FROM leaves) n), ps AS (SELECT DISTINCT seq, path FROM leaves WHERE trim("value") <> '' AND path IN (SELECT path FROM rr WHERE "role"='entity')),
 k AS (SELECT path, count(*) k FROM ps GROUP BY path), b AS (SELECT x.path path_a, y.path path_b, count(*) c FROM ps x JOIN ps y ON x.seq=y.seq AND x.path<y.path GROUP BY ALL), j AS (SELECT path_a, path_b, c, ka.k ka, kb.k kb, nm.n n FROM b JOIN k ka ON ka.path=path_a JOIN k kb ON kb.path=path_b, nm)
 SELECT 'field' kind, path, "role" label, CASE WHEN "role"='entity' THEN {HINT} END hint, total sample_count, total-n null_count, u unique_count, round(u/total::double,6) share FROM rr
 UNION ALL SELECT 'link', path_a || ' ' || path_b, 'CO_OCCURS_WITH', NULL, c, 0, 0, round(greatest({{MI}},0),4) FROM j WHERE greatest({{MI}},0) >= 0.1
 UNION ALL SELECT 'head', 'entities', substr(sha256('[' || string_agg(DISTINCT '"' || path || '"', ', ' ORDER BY '"' || path || '"') || ']'),1,16), NULL, 1, 0, 0, 0 FROM leaves WHERE seq IN (SELECT DISTINCT seq FROM leaves ORDER BY seq LIMIT 10)""".replace("{MI}", MI))
def source_profile(spark, sf_dir):
    """The profile of the entities' fields: its head, every field and every link, a row each."""
    leaves = entity_leaves(spark, sf_dir)
    found = places.stored(profile.source_profile(leaves, leaves.select("seq").distinct().count(), "entities"), "entities")  # one row
    null, zero = F.lit(None), F.lit(0)
    fields = profile.fields_of(found).select(F.lit("field").alias("kind"), "path", F.col("role").alias("label"), F.col("type_hint").alias("hint"), "sample_count", "null_count", "unique_count", F.round("profile_cardinality", 6).alias("share"))
    links = profile.relationships_of(found).select(F.lit("link"), F.concat_ws(" ", "path_a", "path_b"), "relationship_type", null, "both_count", zero, zero, "mutual_information")
    head = found.select(F.lit("head"), "source_id", "fingerprint", null, "revision", zero, zero, zero)
    return fields.union(links).union(head)


NETWORK = """leaves AS (
  SELECT event_id seq, 'kind' path, event_type "value" FROM events UNION ALL SELECT event_id, 'cents', round(value*100)::bigint::varchar FROM events
  UNION ALL SELECT event_id, 'net.addr', CASE WHEN event_id % 9 <> 0 THEN (event_id%199) || '.' || (user_id%23) || '.0.' || (event_id%7) END FROM events WHERE event_type IN ('click','view','error')
  UNION ALL SELECT event_id, 'net.host', 'h' || md5((event_id // 4)::varchar)[1:6] || '.example.org' FROM events WHERE event_type IN ('click','view')
  UNION ALL SELECT event_id, 'digest', md5(event_id::varchar) FROM events WHERE event_type IN ('click','view','signup'))"""


def network_leaves(events: DataFrame) -> DataFrame:
    """Kinds and amounts of all events, addresses, hosts and digests of some."""
    i, u, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
    addr = F.when(i % 9 != 0, F.format_string("%d.%d.0.%d", i % 199, u % 23, i % 7))
    host = F.concat(F.lit("h"), F.substring(F.md5(F.floor(i / 4).cast("string")), 1, 6), F.lit(".example.org"))
    found = {"kind": (None, kind), "cents": (None, F.round(F.col("value") * 100).cast("long").cast("string")), "net.addr": (["click", "view", "error"], addr), "net.host": (["click", "view"], host), "digest": (["click", "view", "signup"], F.md5(i.cast("string")))}
    leaf = lambda k, v: F.struct(F.lit(k).alias("path"), v.alias("value"))
    leaves = F.array_compact(F.array(*(leaf(k, v) if kinds is None else F.when(kind.isin(kinds), leaf(k, v)) for k, (kinds, v) in found.items())))
    return events.select(i.alias("seq"), F.explode(leaves).alias("l")).select("seq", "l.path", "l.value")


def network_revision(spark, sf_dir) -> dict:
    """The last of the revisions that a stream makes of the events, in three batches, each of as many files as Spark writes."""
    folder, out, place = (places.scratch(spark, n) for n in ("events", "revisions", "place"))
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    for part in range(3):
        events.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == part).repartition("event_id").write.mode("append").parquet(folder)
        stream = live.tail(spark, folder, events.schema, files=ALL)
        revisions.watch(stream, network_leaves, out, "network", place).trigger(availableNow=True).start().awaitTermination()
    return versions.latest(out, "network")


@query(f"""SELECT * REPLACE (CASE WHEN unique_count <= 10000 THEN unique_count ELSE -1 END AS unique_count, CASE WHEN unique_count <= 10000 THEN cardinality_ratio END AS cardinality_ratio, CASE WHEN unique_count <= 10000 THEN format_consistency END AS format_consistency),
 unique_count > 10000 wide, true near FROM ({_features_sql(NETWORK)})""")
def revision_features(spark, sf_dir):
    """Features by revisions; what is an estimate is -1 or null here, and near if within 8 % (five standard errors) of the whole table's."""
    record = network_revision(spark, sf_dir)
    found = revisions.feature_table(revisions.load(spark, record["state"]))
    whole = features.consistency(network_leaves(table(spark, sf_dir, "events"))).select("path", F.col("unique_count").alias("u"), F.col("format_consistency").alias("s"))
    near = (F.abs(F.col("unique_count") - F.col("u")) <= F.when(F.col("wide"), 0.08).otherwise(0.0) * F.col("u")) & (F.abs(F.col("format_consistency") - F.col("s")) <= F.when(F.col("wide"), revisions.ERROR).otherwise(1e-12))
    exact = {"unique_count", "cardinality_ratio", "format_consistency"}
    columns = ["sample_count", "null_count", "unique_count", *features.NAMES]
    rounded = [F.round(c, 6).alias(c) if c in features.NAMES else F.col(c) for c in columns]
    kept = [F.when(~F.col("wide"), r).otherwise(-1 if c == "unique_count" else None).alias(c) if c in exact else r for c, r in zip(columns, rounded)]
    return found.join(whole, "path").select("path", *kept, "wide", near.alias("near"))


def _links_sql(leaves: str, label: str) -> str:
    return f"""WITH {leaves}, {ROLES}, nm AS (SELECT count(DISTINCT seq) n FROM leaves), ps AS (SELECT DISTINCT seq, path FROM leaves WHERE trim("value") <> ''),
 k AS (SELECT path, count(*) k FROM ps GROUP BY path), b AS (SELECT x.path path_a, y.path path_b, count(*) c FROM ps x JOIN ps y ON x.seq=y.seq AND x.path<y.path GROUP BY ALL), j AS (SELECT path_a, path_b, c, ka.k ka, kb.k kb, nm.n n FROM b JOIN k ka ON ka.path=path_a JOIN k kb ON kb.path=path_b, nm),
 h AS (SELECT path, "role", CASE WHEN "role"='entity' THEN {HINT} END hint FROM rr)
 SELECT 'field' kind, path, "role" label, hint, (SELECT count(*) FROM leaves l WHERE l.path = h.path) n, NULL::double bits FROM h
 UNION ALL SELECT 'link', path_a || ' ' || path_b, {label}, NULL, c, round(greatest({MI},0),4) FROM j JOIN h a ON a.path=path_a AND a."role"='entity' JOIN h b ON b.path=path_b AND b."role"='entity' WHERE greatest({MI},0) >= 0.1
 UNION ALL SELECT 'head', 'network', substr(sha256('[' || string_agg(DISTINCT '"' || path || '"', ', ' ORDER BY '"' || path || '"') || ']'),1,16), NULL, 3, NULL FROM leaves WHERE seq IN (SELECT DISTINCT seq FROM leaves ORDER BY seq LIMIT 10)"""


def _profile_rows(found: DataFrame) -> DataFrame:
    null = F.lit(None)
    fields = profile.fields_of(found).select(F.lit("field").alias("kind"), "path", F.col("role").alias("label"), F.col("type_hint").alias("hint"), F.col("sample_count").alias("n"), null.cast("double").alias("bits"))
    links = profile.relationships_of(found).select(F.lit("link"), F.concat_ws(" ", "path_a", "path_b"), "relationship_type", null, "both_count", "mutual_information")
    return fields.union(links).union(found.select(F.lit("head"), "source_id", "fingerprint", null, "revision", null))


NETWORK_LABEL = "CASE WHEN least(a.hint,b.hint)='fqdn' AND greatest(a.hint,b.hint)='ipv4' THEN 'RESOLVES_TO' WHEN least(a.hint,b.hint)='fqdn' AND greatest(a.hint,b.hint)='hash_md5' THEN 'OBSERVED_ON' ELSE 'CO_OCCURS_WITH' END"


@query(_links_sql(NETWORK, NETWORK_LABEL))
def revision_profile(spark, sf_dir):
    """The profile of the third revision: head, fields and links."""
    return _profile_rows(places.stored(revisions.source_profile(spark, network_revision(spark, sf_dir)), "network"))


@query(f"""WITH {ENTITIES}, {ROLES} SELECT "role", count(*) n FROM rr GROUP BY ALL""")
def role_counts(spark, sf_dir):
    leaves = entity_leaves(spark, sf_dir)
    found = profile.source_profile(leaves, leaves.select("seq").distinct().count(), "entities")
    return profile.role_counts(found).select("role", "n")


# ---- sources --------------------------------------------------------------------------------------


def event_files(spark, sf_dir, every: int) -> str:
    """A folder of the events as JSON lines, in files below a folder for each type; those whose number `every` divides are cut short."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))
    line = F.to_json(F.struct(*e.columns))
    line = F.when(F.col("event_id") % every == 0, F.expr("left(line, length(line) - 1)")).otherwise(F.col("line"))
    path = places.scratch(spark, "events")
    e.withColumn("line", F.to_json(F.struct(*e.columns))).select(line.alias("line"), F.col("event_type").alias("kind")).write.partitionBy("kind").text(path)
    return path


@query("SELECT event_id, user_id, event_type, event_type kind, round(value*100)::bigint cents, true placed FROM events WHERE event_id % 101 <> 0")
def connector_events(spark, sf_dir):
    """Events from files by the data source, with file and place in their payloads."""
    connector.register(spark)
    rows = spark.read.format(connector.NAME).options(path=event_files(spark, sf_dir, 101), source_id="files", inject="true", split_bytes="200000").load()
    event = F.from_json("payload", "event_id long, user_id long, event_type string, cents long, _index string, _id string")
    found = rows.where("error is null").select("index", "id", F.regexp_extract("index", "kind=([^/]+)", 1).alias("kind"), event.alias("e"))
    return found.select("e.event_id", "e.user_id", "e.event_type", "kind", "e.cents", ((F.col("e._index") == F.col("index")) & (F.col("e._id") == F.col("id"))).alias("placed"))


@query("SELECT event_id, user_id FROM events WHERE event_id % 101 <> 0")
def connector_tail(spark, sf_dir):
    """Events of a stream over files, stopped after every batch and begun again from its checkpoint."""
    connector.register(spark)
    path, out, place = event_files(spark, sf_dir, 101), places.scratch(spark, "tail"), places.scratch(spark, "place")
    for _ in range(2):
        rows = spark.readStream.format(connector.NAME).options(path=path, split_bytes="200000").load().where("error is null")
        found = rows.select(F.from_json("payload", "event_id long, user_id long").alias("e")).select("e.*")
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", place).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_id long, user_id long").parquet(out)


@query("SELECT 'batch' how, count(*) FILTER (WHERE event_id % 7 <> 0) delivered, count(*) FILTER (WHERE event_id % 7 = 0) errors FROM events UNION ALL SELECT 'stream', count(*) FILTER (WHERE event_id % 7 <> 0), count(*) FILTER (WHERE event_id % 7 = 0) FROM events")
def connector_health(spark, sf_dir):
    """Counters of a source, observed as a batch and as a stream run."""
    connector.register(spark)
    options = {"path": event_files(spark, sf_dir, 7), "split_bytes": "200000"}
    once = connector.delivered(spark.read.format(connector.NAME).options(**options).load(), lambda df: df.write.format("noop").mode("overwrite").save())
    stream = connector.observed(spark.readStream.format(connector.NAME).options(**options).load())
    q = stream.writeStream.format("noop").option("checkpointLocation", places.scratch(spark, "place")).trigger(availableNow=True).start()
    q.awaitTermination()
    seen = [p.observedMetrics["health"] for p in q.recentProgress if "health" in p.observedMetrics]
    rows = [("batch", once["delivered"], once["errors"]), ("stream", sum(s["delivered"] for s in seen), sum(s["errors"] for s in seen))]
    return spark.createDataFrame(rows, "how string, delivered long, errors long")


# ---- corrections and learning ---------------------------------------------------------------------

CORRECTIONS = """c AS (SELECT d.doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE lang END source_id, source field_path, CASE WHEN quality=1 THEN 'entity' WHEN toxic=1 THEN 'text' WHEN doc_id % 7 = 0 THEN 'bogus' ELSE 'enum' END correct_label,
 CASE WHEN doc_id % 13 = 0 THEN NULL ELSE (doc_id % 23)/20.0::double END original_confidence FROM documents d JOIN labels USING (doc_id))"""


def corrections(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    label = F.when(F.col("quality") == 1, "entity").when(F.col("toxic") == 1, "text").when(F.col("doc_id") % 7 == 0, "bogus").otherwise("enum")
    return d.select("doc_id", F.when(F.col("doc_id") % 11 != 0, F.col("lang")).alias("source_id"), F.col("source").alias("field_path"), label.alias("correct_label"), F.when(F.col("doc_id") % 13 != 0, (F.col("doc_id") % 23) / F.lit(20.0)).alias("original_confidence"))


@query(f"WITH {CORRECTIONS} SELECT correct_label, count(*) n FROM c GROUP BY ALL")
def correction_counts(spark, sf_dir):
    return corrections(spark, sf_dir).groupBy("correct_label").agg(F.count("*").alias("n"))


@query(f"""WITH {CORRECTIONS} SELECT doc_id, concat_ws(';', CASE WHEN source_id IS NULL THEN 'missing source_id' END, CASE WHEN original_confidence IS NULL THEN 'missing original_confidence' END, CASE WHEN correct_label NOT IN ('entity','metric','enum','temporal','text','unknown') THEN 'invalid label' END, CASE WHEN original_confidence < 0 OR original_confidence > 1 THEN 'confidence out of range' END) errors FROM c""")
def correction_validation(spark, sf_dir):
    return learning.validated(corrections(spark, sf_dir), ["source_id", "field_path", "correct_label", "original_confidence"]).select("doc_id", F.array_join("errors", ";").alias("errors"))


@query("SELECT event_id, (value*1e13)::varchar large, (value/7e6)::varchar small, substr(sha256('events:value:[' || value::varchar || ', ' || (value/3)::varchar || ', ' || (-event_id::double)::varchar || ']'),1,16) vector_id FROM events")
def vector_ids(spark, sf_dir):
    """Identifiers of vectors, and the forms of their numbers."""
    v, i = F.col("value"), F.col("event_id")
    rows = table(spark, sf_dir, "events").withColumn("v", F.array(v, v / 3, -i.cast("double"))).withColumn("s", F.lit("events")).withColumn("p", F.lit("value"))
    return rows.select("event_id", numbers.shortest(v * 1e13).alias("large"), numbers.shortest(v / 7e6).alias("small"), checks.vector_id("s", "p", "v").alias("vector_id"))


@query(f"WITH {CORRECTIONS} SELECT doc_id FROM c WHERE coalesce(original_confidence, 1.0) < 0.6")
def flagged_corrections(spark, sf_dir):
    return learning.flagged(corrections(spark, sf_dir)).select("doc_id")


@query()
def rf_predict(spark, sf_dir):
    """Roles of the events' and entities' fields by a forest learnt from examples of each role."""
    model = learning.train(learning.bootstrap(spark))
    fields = features.vector(features.field_features(entity_leaves(spark, sf_dir)))
    return learning.predict(model, fields).select("path", "label", "confidence", "flagged")


@query()
def field_clusters(spark, sf_dir):
    """Density clusters of the fields of the events and entities."""
    fields = features.vector(features.field_features(entity_leaves(spark, sf_dir).unionByName(event_leaves(spark, sf_dir))))
    return learning.clusters(fields)


# ---- telemetry ------------------------------------------------------------------------------------

REC = "rec AS (SELECT user_id file, event_type name, event_id seq, epoch_us(ts) t, value FROM events)"
GPS = "gps AS (SELECT file, seq, t, (seq*7)%5 status, (seq*3)%11 nsats, value/100 hdop, -35+value/1e7 lat, 149+value/1e7 lon, value alt FROM rec WHERE name IN ('view','click'))"
EKF = "ekf AS (SELECT file, seq, t, value/60 ivn, value/80 ive FROM rec WHERE name = 'error')"


def records(spark, sf_dir):
    t = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("file"), F.col("event_type").alias("name"), F.col("event_id").alias("seq"), t.alias("t"), "value")


def gps(spark, sf_dir):
    r = records(spark, sf_dir).where("name in ('view', 'click')")
    v = F.col("value")
    return r.select("file", "seq", "t", (F.col("seq") * 7 % 5).alias("status"), (F.col("seq") * 3 % 11).alias("nsats"), (v / 100).alias("hdop"), (-35 + v / 1e7).alias("lat"), (149 + v / 1e7).alias("lon"), v.alias("alt"))


def baro(spark, sf_dir):
    return records(spark, sf_dir).where("name = 'purchase'").select("file", "seq", "t", F.col("value").alias("alt"))


def ekf(spark, sf_dir):
    return records(spark, sf_dir).where("name = 'error'").select("file", "seq", "t", (F.col("value") / 60).alias("ivn"), (F.col("value") / 80).alias("ive"))


@query(f"WITH {REC}, s AS (SELECT file, name, arg_max(t,seq)-arg_min(t,seq) d FROM rec GROUP BY ALL HAVING count(*)>1) SELECT file, max(d) duration_us FROM s GROUP BY file")
def session_duration(spark, sf_dir):
    return telemetry.session_duration(records(spark, sf_dir))


@query(f"WITH {REC}, g AS (SELECT file, name, lead(t) OVER (PARTITION BY file,name ORDER BY seq)-t gap FROM rec) SELECT file, name, round(1e6/quantile_disc(gap,0.5 ORDER BY gap DESC)::double,9) hz FROM g WHERE gap>0 GROUP BY ALL")
def logging_frequency(spark, sf_dir):
    return telemetry.logging_frequency(records(spark, sf_dir)).withColumn("hz", F.round("hz", 9))


@query(f"WITH {REC}, {GPS}, s AS (SELECT file, seq, status>=3 fix FROM gps WHERE status>=3 OR status<=1), w AS (SELECT file, fix, lag(fix) OVER (PARTITION BY file ORDER BY seq) was, max(fix::int) OVER (PARTITION BY file ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) had FROM s) SELECT file, count(*) FILTER (WHERE fix AND NOT was AND had=1) glitches FROM w GROUP BY file")
def glitch_count(spark, sf_dir):
    return telemetry.gps_glitches(gps(spark, sf_dir))


@query(f"WITH {REC}, {GPS}, s AS (SELECT file, seq, status>=3 fix FROM gps WHERE status>=3 OR status<=1), w AS (SELECT file, fix, lag(fix) OVER (PARTITION BY file ORDER BY seq) was, max(fix::int) OVER (PARTITION BY file ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) had FROM s) SELECT file, count(*) FILTER (WHERE fix AND NOT was AND had=1) glitches FROM w GROUP BY file HAVING count(*) FILTER (WHERE fix AND NOT was AND had=1) > 0")
def glitch_stream(spark, sf_dir):
    """As glitch_count, where it isn't 0, from a stream of points that come out of order and in several batches."""
    folder, out, place = (places.scratch(spark, n) for n in ("points", "glitches", "place"))
    points = gps(spark, sf_dir).select("file", "seq", "status", F.timestamp_seconds(F.col("seq") + 1_000).alias("at"))
    span = points.agg(F.max("seq")).first()[0] or 0
    shuffled = points.withColumn("part", F.least(F.floor((F.col("seq") + F.abs(F.xxhash64("seq")) % (span // 10 + 1)) * 3 / (span + 1)), F.lit(3)))
    end = spark.range(1).select(F.lit(-1).cast(points.schema["file"].dataType).alias("file"), F.col("id").alias("seq"), F.lit(0).cast("long").alias("status"), F.timestamp_seconds(F.lit(10 * span + 10**6)).alias("at"))
    parts = [shuffled.where(F.col("part") == part).drop("part").repartition("file") for part in range(4)] + [end]  # the end moves the watermark past the last points
    for part, rows in enumerate(parts):  # a batch each, of as many files as Spark writes; stopped and begun again
        rows.write.parquet(f"{folder}/part={part}")
        stream = live.glitches_in_order(live.tail(spark, f"{folder}/*", points.schema, files=ALL), "at", f"{span // 10 + 1} seconds")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", place).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("file long, glitches long").parquet(out).groupBy("file").agg(F.max("glitches").alias("glitches")).where("glitches > 0")


@query(f"WITH {REC}, {GPS}, s AS (SELECT file, abs(lat-lag(lat) OVER (PARTITION BY file ORDER BY seq)) d FROM gps) SELECT file, count(*) FILTER (WHERE d>1e-5) position_changes FROM s GROUP BY file")
def position_changes(spark, sf_dir):
    return telemetry.position_changes(gps(spark, sf_dir))


JUMPS = """sp AS (SELECT file, CASE WHEN count(*) FILTER (WHERE status>=3)>=5 AND max(nsats)>4 THEN 30.0 ELSE 0.5 END speed FROM gps GROUP BY file),
 st AS (SELECT file, t, status, lat, lon, lag(t) OVER w pt, lag(status) OVER w ps, lag(lat) OVER w plat, lag(lon) OVER w plon FROM gps WINDOW w AS (PARTITION BY file ORDER BY seq)),
 m AS (SELECT file, greatest((t-pt)/1e6,0.1) s, sqrt(((lat-plat)*111320.0)**2+((lon-plon)*111320.0*cos(radians((lat+plat)/2)))**2) m FROM st WHERE status>=3 AND ps>=3),
 jp AS (SELECT sp.file, count(m) steps, coalesce(max(m),0) max_jump_m, count(*) FILTER (WHERE m>speed*s*5) jumps, count(*) FILTER (WHERE m>speed*s*5 AND m>speed*5) alerts FROM sp LEFT JOIN m USING (file) GROUP BY sp.file)"""


@query(f"WITH {REC}, {GPS}, {JUMPS} SELECT file, steps, round(max_jump_m,6) max_jump_m, jumps, alerts, CASE WHEN alerts>0 THEN 'ALERT' WHEN jumps>0 THEN 'SUSPICIOUS' ELSE 'CLEAN' END verdict FROM jp")
def jump_detect(spark, sf_dir):
    return telemetry.position_jumps(gps(spark, sf_dir)).select("file", "steps", F.round("max_jump_m", 6).alias("max_jump_m"), "jumps", "alerts", "verdict")


SHIFTS = """qd AS (SELECT file, hdop-lag(hdop) OVER w h, nsats-lag(nsats) OVER w s FROM gps WINDOW w AS (PARTITION BY file ORDER BY seq)),
 qs AS (SELECT file, count(*) n, coalesce(max(CASE WHEN h<-1 THEN -h END),0) max_drop, coalesce(max(CASE WHEN h>2 THEN h END),0) max_spike, greatest(coalesce(max(-s),0),0) max_sat_drop FROM qd GROUP BY file),
 qv AS (SELECT *, CASE WHEN n<3 THEN 'UNKNOWN' WHEN (max_drop>=1 AND max_spike=0) OR max_spike>=2 OR max_sat_drop>=4 THEN 'SUSPICIOUS' ELSE 'CLEAN' END verdict FROM qs)"""


@query(f"WITH {REC}, {GPS}, {SHIFTS} SELECT file, n, round(max_drop,6) max_drop, round(max_spike,6) max_spike, max_sat_drop, verdict FROM qv")
def quality_shift(spark, sf_dir):
    return telemetry.quality_shifts(gps(spark, sf_dir)).select("file", "n", F.round("max_drop", 6).alias("max_drop"), F.round("max_spike", 6).alias("max_spike"), "max_sat_drop", "verdict")


NEAR = """b AS (SELECT file, t bt, arg_min(value,seq) balt FROM rec WHERE name='purchase' GROUP BY ALL),
 nr AS (SELECT * FROM (SELECT g.file, g.seq, g.t, g.alt, g.status, bt, balt, abs(g.t-bt) gap, row_number() OVER (PARTITION BY g.file,g.seq ORDER BY abs(g.t-bt), bt) r FROM gps g LEFT JOIN b USING (file)) WHERE r=1)"""


@query(f"WITH {REC}, {GPS}, {NEAR} SELECT file, seq, CASE WHEN gap<=2000000000 THEN gap ELSE -1 END gap, CASE WHEN gap<=2000000000 THEN balt ELSE -1 END AS other FROM nr")
def nearest_asof(spark, sf_dir):
    return telemetry.nearest_in_time(gps(spark, sf_dir).select("file", "seq", "t", "alt"), baro(spark, sf_dir), 2_000_000_000).select("file", "seq", F.coalesce("gap", F.lit(-1)).alias("gap"), F.coalesce("other", F.lit(-1.0)).alias("other"))


@query(f"""WITH {REC}, {GPS}, {NEAR}, fx AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY seq) rk FROM nr WHERE status>=3), ok AS (SELECT * FROM fx WHERE gap<=2000000000), o AS (SELECT file, avg(alt-balt) off FROM ok WHERE rk<=5 GROUP BY file)
 SELECT f.file, coalesce(count(d),0) samples, round(any_value(off),6) offset_m, round(max(d),6) max_div_m, round(avg(d),6) avg_div_m, CASE WHEN count(d)=0 THEN 'UNKNOWN' WHEN max(d)>=20 THEN 'ALERT' WHEN max(d)>=10 THEN 'SUSPICIOUS' ELSE 'CLEAN' END verdict FROM (SELECT DISTINCT file FROM gps) f LEFT JOIN (SELECT ok.file, o.off, abs(alt-(balt+off)) d FROM ok JOIN o USING (file)) x USING (file) GROUP BY f.file""")
def altitude_baseline(spark, sf_dir):
    found = telemetry.altitude_divergence(gps(spark, sf_dir), baro(spark, sf_dir), tolerance=2_000_000_000)
    return found.select("file", "samples", *(F.round(c, 6).alias(c) for c in ("offset_m", "max_div_m", "avg_div_m")), "verdict")


@query(f"WITH {REC}, {EKF}, m AS (SELECT *, sqrt(ivn*ivn+ive*ive) m FROM ekf) SELECT file, count(*) n, round(max(m),6) max_mag, round(avg(m),6) mean_mag, arg_min(t, (-m, t, seq)) max_t, count(*) FILTER (WHERE m>10) over_10, count(*) FILTER (WHERE m>5) over_5, CASE WHEN max(m)>10 THEN 'ALERT' WHEN max(m)>5 THEN 'SUSPICIOUS' ELSE 'CLEAN' END verdict FROM m GROUP BY file")
def ekf_stats(spark, sf_dir):
    return telemetry.innovation(ekf(spark, sf_dir)).withColumn("max_mag", F.round("max_mag", 6)).withColumn("mean_mag", F.round("mean_mag", 6))


@query(f"WITH {REC}, l AS (SELECT file, 'P' || (seq%12) param, arg_max(value,seq) v FROM rec WHERE seq%12<7 GROUP BY ALL) SELECT file, substr(sha256(string_agg(param || '=' || printf('%.4f', v), '|' ORDER BY param || '=' || printf('%.4f', v))),1,8) fingerprint FROM l GROUP BY file")
def config_fingerprint(spark, sf_dir):
    params = records(spark, sf_dir).select("file", "seq", F.concat(F.lit("P"), (F.col("seq") % 12).cast("string")).alias("param"), "value")
    return telemetry.config_fingerprint(params, [f"P{i}" for i in range(7)])


AGG = """ag AS (SELECT file, count(*) FILTER (WHERE name IN ('view','click') AND (seq*7)%5>=3) fixes, coalesce(max(CASE WHEN name IN ('view','click') THEN (seq*3)%11 END),0) nsats, count(*) FILTER (WHERE name IN ('view','click')) statuses, coalesce(max(CASE WHEN name IN ('view','click') THEN (seq*7)%5 END),0) top,
 count(*) FILTER (WHERE name='purchase') baro_n, coalesce(max(CASE WHEN name='purchase' THEN value END)-min(CASE WHEN name='purchase' THEN value END),0) baro_range, count(*) FILTER (WHERE name='signup') modes, count(*) FILTER (WHERE name='signup' AND seq%8 IN (3,4,5,6)) flying, count(*) FILTER (WHERE name='signup' AND seq%8 IN (0,1,2)) ground,
 count(*) FILTER (WHERE name='error' AND seq%9=0) errs, count(*) FILTER (WHERE name='error' AND seq%10=6) compass, (max(t)-min(t))/1e6 dur FROM rec GROUP BY file)"""


def _file_aggregates(spark, sf_dir):
    r = records(spark, sf_dir)
    point, is_ = F.col("name").isin("view", "click"), lambda n: F.col("name") == n
    s = F.col("seq")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return r.groupBy("file").agg(
        F.count_if(point & (s * 7 % 5 >= 3)).alias("fixes"), zero(F.max(F.when(point, s * 3 % 11))).alias("nsats"), F.count_if(point).alias("statuses"), zero(F.max(F.when(point, s * 7 % 5))).alias("top"),
        F.count_if(is_("purchase")).alias("baro_n"), zero(F.max(F.when(is_("purchase"), F.col("value"))) - F.min(F.when(is_("purchase"), F.col("value")))).alias("baro_range"),
        F.count_if(is_("signup")).alias("modes"), F.count_if(is_("signup") & (s % 8).isin(3, 4, 5, 6)).alias("flying"), F.count_if(is_("signup") & (s % 8).isin(0, 1, 2)).alias("ground"),
        F.count_if(is_("error") & (s % 9 == 0)).alias("errs"), F.count_if(is_("error") & (s % 10 == 6)).alias("compass"), ((F.max("t") - F.min("t")) / 1e6).alias("dur"),
    )


@query(f"WITH {REC}, {AGG} SELECT file, CASE WHEN fixes>5 AND nsats>4 THEN 'flight' WHEN baro_n>1 AND baro_range>5 THEN 'flight' WHEN baro_n>1 AND baro_range<=2 AND (statuses=0 OR top<=1) THEN 'ground' WHEN flying>0 THEN 'flight' WHEN modes>0 AND ground=modes THEN 'ground' WHEN statuses>0 AND top<=1 THEN 'ground' ELSE 'unknown' END session_type FROM ag")
def session_cascade(spark, sf_dir):
    c = F.col
    kind = telemetry.session_class(c("fixes"), c("nsats"), c("statuses"), c("top"), c("baro_n"), c("baro_range"), c("modes"), c("flying"), c("ground"))
    return _file_aggregates(spark, sf_dir).select("file", kind.alias("session_type"))


@query(f"WITH {REC}, {AGG} SELECT file, CASE WHEN dur<5 THEN 'exclude' WHEN errs>0 OR compass>0 THEN 'contains_deviations' WHEN modes=0 OR dur<30 THEN 'review' ELSE 'clean_baseline' END verdict, CASE WHEN dur<5 THEN 'duration_too_short' WHEN errs>0 OR compass>0 THEN concat_ws(';', CASE WHEN errs>0 THEN 'err_count=' || errs END, CASE WHEN compass>0 THEN 'compass_warnings=' || compass END) ELSE concat_ws(';', CASE WHEN modes=0 THEN 'no_parm_records' END, CASE WHEN dur<30 THEN 'short_duration' END) END reasons FROM ag")
def usability_verdict(spark, sf_dir):
    verdict, reasons = telemetry.usability(F.col("dur"), F.col("modes"), {"err_count": F.col("errs"), "compass_warnings": F.col("compass")})
    return _file_aggregates(spark, sf_dir).select("file", verdict.alias("verdict"), F.array_join(reasons, ";").alias("reasons"))


FINDINGS = f"""{JUMPS}, {SHIFTS}, {NEAR}, en AS (SELECT file, count(*)>=5 ok FROM gps GROUP BY file),
 fx AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY seq) rk FROM nr WHERE status>=3), okk AS (SELECT * FROM fx WHERE gap<=2000000), o AS (SELECT file, avg(alt-balt) off FROM okk WHERE rk<=5 GROUP BY file), dv AS (SELECT okk.file, max(abs(alt-(balt+off))) d FROM okk JOIN o USING (file) GROUP BY okk.file),
 ek AS (SELECT file, max(sqrt(ivn*ivn+ive*ive)) m FROM ekf GROUP BY file),
 fd AS (SELECT en.file, 'position_jump' "check", CASE WHEN NOT ok THEN 'UNKNOWN' WHEN alerts>0 THEN 'ALERT' WHEN jumps>0 THEN 'SUSPICIOUS' ELSE 'CLEAN' END verdict, 0.40::double w FROM en JOIN jp USING (file)
  UNION ALL SELECT en.file, 'gps_quality', CASE WHEN NOT ok THEN 'UNKNOWN' ELSE verdict END, 0.20 FROM en JOIN qv USING (file)
  UNION ALL SELECT en.file, 'alt_divergence', CASE WHEN NOT ok OR d IS NULL THEN 'UNKNOWN' WHEN d>=20 THEN 'ALERT' WHEN d>=10 THEN 'SUSPICIOUS' ELSE 'CLEAN' END, 0.25 FROM en LEFT JOIN dv USING (file)
  UNION ALL SELECT en.file, 'ekf_innovation', CASE WHEN NOT ok OR m IS NULL THEN 'UNKNOWN' WHEN m>10 THEN 'ALERT' WHEN m>5 THEN 'SUSPICIOUS' ELSE 'CLEAN' END, 0.15 FROM en LEFT JOIN ek USING (file)),
 sc AS (SELECT *, CASE verdict WHEN 'ALERT' THEN 2 WHEN 'SUSPICIOUS' THEN 1 WHEN 'CLEAN' THEN 0 END s FROM fd),
 vd AS (SELECT file, CASE max(s) WHEN 2 THEN 'ALERT' WHEN 1 THEN 'SUSPICIOUS' WHEN 0 THEN 'CLEAN' ELSE 'UNKNOWN' END verdict, CASE WHEN max(s) IS NULL THEN 0 ELSE least(least(sum(CASE WHEN s IS NOT NULL THEN w END),1)*(0.5+0.5*sum(w*s)/sum(CASE WHEN s IS NOT NULL THEN w END)),1) END confidence FROM sc GROUP BY file)"""


def _findings(spark, sf_dir):
    return telemetry.spoof_findings(gps(spark, sf_dir), baro(spark, sf_dir), ekf(spark, sf_dir))


@query(f"WITH {REC}, {GPS}, {EKF}, {FINDINGS} SELECT file, verdict, round(confidence,6) confidence FROM vd")
def verdict_aggregate(spark, sf_dir):
    return telemetry.weighted_verdict(_findings(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


@query(f"WITH {REC}, {GPS}, {EKF}, {FINDINGS} SELECT \"check\", count(*) FILTER (WHERE verdict='CLEAN') \"CLEAN\", count(*) FILTER (WHERE verdict='SUSPICIOUS') \"SUSPICIOUS\", count(*) FILTER (WHERE verdict='ALERT') \"ALERT\", count(*) FILTER (WHERE verdict='UNKNOWN') \"UNKNOWN\" FROM fd GROUP BY ALL")
def check_breakdown(spark, sf_dir):
    findings = _findings(spark, sf_dir)
    return telemetry.analysis_summary(findings, telemetry.weighted_verdict(findings))[1]


class Odd(analyses.Check):
    """How many points of a file there are; fails on files whose number 7 divides."""

    name = "odd"

    def __init__(self):
        self.n = 0

    def see(self, row):
        self.n += row["kind"] == "gps"
        if row["file"] % 7 == 0:
            raise ValueError("a file that can't be checked")

    def finding(self):
        return "CLEAN", None, self.n, None


@query(f"""WITH {REC}, {GPS}, {EKF}, {FINDINGS} SELECT file, "check", verdict, NULL::double points FROM fd
 UNION ALL SELECT file, 'odd', CASE WHEN file % 7 = 0 THEN 'ERROR' WHEN count(*) >= 5 THEN 'CLEAN' ELSE 'UNKNOWN' END, CASE WHEN file % 7 <> 0 AND count(*) >= 5 THEN count(*)::double END FROM gps GROUP BY file""")
def checks_by_file(spark, sf_dir):
    """The four checks and one more, which fails on some files, as a table function of each file."""
    found = analyses.spoof_findings(gps(spark, sf_dir), baro(spark, sf_dir), ekf(spark, sf_dir), [Odd])
    return found.select("file", "check", "verdict", F.when(F.col("check") == "odd", F.col("value")).alias("points"))


@query(f"WITH {REC}, {GPS}, {EKF}, {FINDINGS} SELECT verdict, count(*) files, round(avg(CASE WHEN confidence>0 THEN confidence END),6) confidence FROM vd GROUP BY verdict")
def analysis_summary(spark, sf_dir):
    findings = _findings(spark, sf_dir)
    return telemetry.analysis_summary(findings, telemetry.weighted_verdict(findings))[0].withColumn("confidence", F.round("confidence", 6))


@query(f"WITH {REC}, {AGG}, s AS (SELECT CASE WHEN errs>0 OR compass>0 THEN 'contains_deviations' ELSE 'clean_baseline' END verdict, dur FROM ag) SELECT verdict, count(*) files, min(dur) lo, max(dur) hi, quantile_disc(dur,0.5 ORDER BY dur DESC) median FROM s GROUP BY verdict")
def corpus_summary(spark, sf_dir):
    files = _file_aggregates(spark, sf_dir).withColumn("verdict", F.when((F.col("errs") > 0) | (F.col("compass") > 0), "contains_deviations").otherwise("clean_baseline")).withColumn("one", F.lit(1))
    middle = features.upper_median(files, ["verdict"], "dur", "one")
    return files.groupBy("verdict").agg(F.count("*").alias("files"), F.min("dur").alias("lo"), F.max("dur").alias("hi")).join(middle, "verdict")


@query("SELECT event_type name, count(*) n, round(100.0*count(*)/sum(count(*)) OVER ()::double,6) percent FROM events GROUP BY ALL")
def type_counts_pct(spark, sf_dir):
    return explore.type_shares(records(spark, sf_dir)).withColumn("percent", F.round("percent", 6))


@query("SELECT event_type name, least(count(DISTINCT round(value,6)),500) uniques, min(value) lo, max(value) hi, array_to_string(list(value ORDER BY event_id)[1:5], ';') samples FROM events GROUP BY ALL")
def field_stats_capped(spark, sf_dir):
    found = explore.field_stats(records(spark, sf_dir), ["name"])
    return found.withColumn("uniques", F.col("uniques").cast("long")).withColumn("samples", F.array_join(F.transform("samples", lambda x: x.cast("string")), ";"))


@query("SELECT event_type name, count(*) FILTER (WHERE user_id%3=0) f0, count(*) FILTER (WHERE user_id%3=1) f1, count(*) FILTER (WHERE user_id%3=2) f2 FROM events GROUP BY ALL")
def type_matrix_pivot(spark, sf_dir):
    return explore.type_matrix(records(spark, sf_dir).withColumn("file", F.concat(F.lit("f"), (F.col("file") % 3).cast("string"))))


@query("WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type='signup'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type='purchase') SELECT 'common' kind, user_id FROM a INTERSECT SELECT 'common', user_id FROM b UNION ALL (SELECT 'only_a', user_id FROM a EXCEPT SELECT 'only_a', user_id FROM b) UNION ALL (SELECT 'only_b', user_id FROM b EXCEPT SELECT 'only_b', user_id FROM a)")
def set_compare(spark, sf_dir):
    """Users who signed up, who purchased, and both: the sets of names of two files."""
    names = records(spark, sf_dir).select(F.col("name").alias("file"), F.col("file").alias("name"))
    return explore.set_comparison(names, "signup", "purchase").withColumnRenamed("name", "user_id")


@query(f"WITH {REC}, {EKF}, p AS (SELECT file, max(sqrt(ivn*ivn+ive*ive)) peak, file%5=0 attack FROM ekf GROUP BY file), c AS (SELECT i, 0.1+i*14.9/499.0::double threshold FROM range(500) r(i)) SELECT i, round(threshold,6) threshold, round(count(*) FILTER (WHERE attack AND peak>threshold)/(count(*) FILTER (WHERE attack))::double,6) tpr, round(count(*) FILTER (WHERE NOT attack AND peak>threshold)/(count(*) FILTER (WHERE NOT attack))::double,6) fpr FROM p, c GROUP BY i, threshold")
def threshold_sweep(spark, sf_dir):
    peaks = telemetry.innovation(ekf(spark, sf_dir)).select(F.col("max_mag").alias("peak"), (F.col("file") % 5 == 0).alias("attack"))
    return telemetry.threshold_sweep(peaks).select(F.col("i").cast("long").alias("i"), *(F.round(c, 6).alias(c) for c in ("threshold", "tpr", "fpr")))


@query(f"WITH {REC}, {EKF}, p AS (SELECT file, max(sqrt(ivn*ivn+ive*ive)) peak, file%5=0 attack FROM ekf GROUP BY file) SELECT round(max(peak) FILTER (WHERE NOT attack),6) ceiling, round(min(peak) FILTER (WHERE attack),6) floor FROM p")
def peak_bounds(spark, sf_dir):
    peaks = telemetry.innovation(ekf(spark, sf_dir)).select(F.col("max_mag").alias("peak"), (F.col("file") % 5 == 0).alias("attack"))
    return explore.bounds_of_peaks(peaks).select(F.round("ceiling", 6).alias("ceiling"), F.round("floor", 6).alias("floor"))


@query(f"WITH {REC}, {EKF}, p AS (SELECT file, max(sqrt(ivn*ivn+ive*ive)) peak FROM ekf GROUP BY file), q AS (SELECT peak, peak >= 8 attack FROM p), c AS (SELECT 0.1+i*14.9/499.0::double threshold FROM range(500) r(i)), s AS (SELECT threshold, count(*) FILTER (WHERE attack AND peak>threshold)/(count(*) FILTER (WHERE attack))::double tpr, count(*) FILTER (WHERE NOT attack AND peak>threshold)/(count(*) FILTER (WHERE NOT attack))::double fpr FROM q, c GROUP BY threshold) SELECT round(min(CASE WHEN fpr=0 AND tpr=1 THEN threshold END),6) optimal FROM s")
def optimal_threshold(spark, sf_dir):
    """Attacks being the files with a peak of 8 and more."""
    peaks = telemetry.innovation(ekf(spark, sf_dir)).select(F.col("max_mag").alias("peak"), (F.col("max_mag") >= 8).alias("attack"))
    return explore.best_threshold(telemetry.threshold_sweep(peaks)).withColumn("optimal", F.round("optimal", 6))


@query(f'WITH {REC} SELECT file, seq, round((t-first_value(t) OVER (PARTITION BY file, name ORDER BY seq))/1e6,6) AS "seconds" FROM rec')
def relative_time(spark, sf_dir):
    return explore.relative_series(records(spark, sf_dir), ["file", "name"]).select("file", "seq", F.round("seconds", 6).alias("seconds"))


@query("SELECT event_type name, count(DISTINCT user_id % 7) files FROM events GROUP BY ALL")
def names_in_files(spark, sf_dir):
    return explore.all_names(records(spark, sf_dir).withColumn("file", F.col("file") % 7))


@query("WITH b AS (SELECT min(value) lo, max(value) hi FROM events) SELECT least(floor((value-lo)/((hi-lo)/20)),19)::bigint bin, count(*) n FROM events, b GROUP BY ALL")
def histogram20(spark, sf_dir):
    return explore.histogram(records(spark, sf_dir))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)")
def file_semi(spark, sf_dir):
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem").where("l_quantity > 49"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 10)")
def file_anti(spark, sf_dir):
    return table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem").where("l_quantity > 10"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


# ---- binary logs ----------------------------------------------------------------------------------

LOG_TYPES = [
    (1, "GPS", "QBBdLLd", "TimeUS,Status,NSats,HDop,Lat,Lng,Alt"), (2, "BARO", "Qd", "TimeUS,Alt"), (3, "XKF1", "Qdd", "TimeUS,IVN,IVE"),
    (4, "MODE", "QB", "TimeUS,Mode"), (9, "SIM", "Qf", "TimeUS,Wind"),
]
LOGGED = """rec AS (SELECT 'f' || (user_id%40) || '.BIN' file, event_type name, row_number() OVER (PARTITION BY user_id%40 ORDER BY event_id)-1 seq, event_id, epoch_us(ts) t, value FROM events),
 gps AS (SELECT file, seq, t, (event_id*7)%5 status, (event_id*3)%11 nsats, value/100 hdop, (-350000000+event_id*7%1000)/1e7 lat, (1490000000+event_id*3%1000)/1e7 lon, value alt FROM rec WHERE name IN ('view','click'))"""


def logs(spark, sf_dir):
    """The events written as binary logs, some users to a file, and read in ranges that cut the files."""
    c, t = F.col, F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    i, v, us = c("event_id"), c("value"), t.cast("double")
    point = F.array(us, i * 7 % 5, i * 3 % 11, v / 100, -350_000_000 + i * 7 % 1000, 1_490_000_000 + i * 3 % 1000, v)
    kinds = [("purchase", 2, F.array(us, v)), ("error", 3, F.array(us, v / 60, v / 80)), ("signup", 4, F.array(us, i % 8))]
    number, values = F.lit(1), point.cast("array<double>")
    for name, kind, columns in kinds:
        number = F.when(c("event_type") == name, kind).otherwise(number)
        values = F.when(c("event_type") == name, columns.cast("array<double>")).otherwise(values)
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("f"), (c("user_id") % 40).cast("string")).alias("file"), i.alias("seq"), number.alias("type_id"), values.alias("values"))
    folder = places.scratch(spark, "logs")
    logscan.write_logs(rows, folder, LOG_TYPES)
    return logscan.Logs(spark, folder, split=1 << 16)


@query(f"WITH {LOGGED} SELECT file, seq, CASE name WHEN 'purchase' THEN 'BARO' WHEN 'error' THEN 'XKF1' WHEN 'signup' THEN 'MODE' ELSE 'GPS' END name, t FROM rec")
def log_records(spark, sf_dir):
    """Every record of binary logs."""
    return logs(spark, sf_dir).records().select("file", "seq", "name", "t")


@query(f"WITH {LOGGED} SELECT file, seq, t, status, nsats, hdop, lat, lon, alt FROM gps")
def log_positions(spark, sf_dir):
    """Typed columns of one type of record."""
    found = logs(spark, sf_dir).typed("GPS")
    return found.select("file", "seq", F.col("TimeUS").cast("long").alias("t"), F.col("Status").alias("status"), F.col("NSats").alias("nsats"), F.col("HDop").alias("hdop"), F.col("Lat").alias("lat"), F.col("Lng").alias("lon"), F.col("Alt").alias("alt"))


@query("SELECT file, unnest([1,2,3,4,9]) type_id, unnest(['GPS','BARO','XKF1','MODE','SIM']) name, unnest([37,19,27,12,15]) length, unnest([7,2,3,2,2]) fields FROM (SELECT DISTINCT 'f' || (user_id%40) || '.BIN' file FROM events)")
def log_types(spark, sf_dir):
    """Types that logs describe, with or without records."""
    return logs(spark, sf_dir).types().select("file", "type_id", "name", "length", F.size("columns").alias("fields"))


INVENTORY = f"""{LOGGED}, du AS (SELECT file, max(d) duration_us FROM (SELECT file, arg_max(t,seq)-arg_min(t,seq) d FROM rec GROUP BY file, CASE WHEN name IN ('view','click') THEN 'GPS' ELSE name END HAVING count(*)>1) GROUP BY file),
 st AS (SELECT file, seq, status>=3 fix FROM gps WHERE status>=3 OR status<=1), sw AS (SELECT file, fix, lag(fix) OVER (PARTITION BY file ORDER BY seq) was, max(fix::int) OVER (PARTITION BY file ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) had FROM st),
 gl AS (SELECT file, count(*) FILTER (WHERE fix AND NOT was AND had=1) glitches FROM sw GROUP BY file), pc AS (SELECT file, count(*) FILTER (WHERE d>1e-5) position_changes FROM (SELECT file, abs(lat-lag(lat) OVER (PARTITION BY file ORDER BY seq)) d FROM gps) GROUP BY file),
 ag AS (SELECT file, count(*) FILTER (WHERE name IN ('view','click') AND (event_id*7)%5>=3) fixes, coalesce(max(CASE WHEN name IN ('view','click') THEN (event_id*3)%11 END),0) nsats_max, coalesce(min(CASE WHEN name IN ('view','click') THEN value/100 END),99.99) hdop_min, count(*) FILTER (WHERE name IN ('view','click')) statuses, coalesce(max(CASE WHEN name IN ('view','click') THEN (event_id*7)%5 END),0) top,
  count(*) FILTER (WHERE name='purchase') baro_n, coalesce(max(CASE WHEN name='purchase' THEN value END)-min(CASE WHEN name='purchase' THEN value END),0) baro_range, count(*) FILTER (WHERE name='signup') modes, count(*) FILTER (WHERE name='signup' AND event_id%8 IN (3,4,5,6)) flying, count(*) FILTER (WHERE name='signup' AND event_id%8 IN (0,1,2)) ground FROM rec GROUP BY file),
 inv AS (SELECT ag.file, duration_us/1e6 duration_s, nsats_max, hdop_min, baro_n, modes, coalesce(glitches,0) glitches, coalesce(position_changes,0) position_changes, 'BARO,GPS,MODE,SIM,XKF1' types,
  CASE WHEN fixes>5 AND nsats_max>4 THEN 'flight' WHEN baro_n>1 AND baro_range>5 THEN 'flight' WHEN baro_n>1 AND baro_range<=2 AND (statuses=0 OR top<=1) THEN 'ground' WHEN flying>0 THEN 'flight' WHEN modes>0 AND ground=modes THEN 'ground' WHEN statuses>0 AND top<=1 THEN 'ground' ELSE 'unknown' END session_type,
  CASE WHEN duration_us/1e6<5 THEN 'exclude' WHEN coalesce(glitches,0)>0 THEN 'contains_deviations' ELSE 'review' END verdict FROM ag LEFT JOIN du USING (file) LEFT JOIN gl USING (file) LEFT JOIN pc USING (file))"""


def _inventory(spark, sf_dir):
    found = logs(spark, sf_dir)
    return corpus.inventory(places.stored(found.records(), "records"), found.types())


@query(f"WITH {INVENTORY} SELECT * FROM inv")
def log_inventory(spark, sf_dir):
    """A row for each log: durations, extremes, counts, session, types and verdict."""
    columns = ["duration_s", "nsats_max", "hdop_min", "baro_n", "modes", "glitches", "position_changes"]
    return _inventory(spark, sf_dir).select("file", *columns, F.array_join("message_types_present", ",").alias("types"), "session_type", "verdict")


@query(f"WITH {INVENTORY} SELECT count(*) total_files, count(duration_s) files, min(duration_s) lo, max(duration_s) hi, quantile_disc(duration_s, 0.5 ORDER BY duration_s DESC) median, (SELECT string_agg(verdict || '=' || n, ',' ORDER BY verdict) FROM (SELECT verdict, count(*) n FROM inv GROUP BY ALL)) verdicts, (SELECT string_agg(session_type || '=' || n, ',' ORDER BY session_type) FROM (SELECT session_type, count(*) n FROM inv GROUP BY ALL)) sessions FROM inv")
def log_summary(spark, sf_dir):
    """The summary of all logs."""
    text = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    found = corpus.summary(_inventory(spark, sf_dir))
    return found.select("total_files", "files", "lo", "hi", "median", text("verdict_counts").alias("verdicts"), text("session_type_counts").alias("sessions"))


@query(f"WITH {LOGGED}, {EKF}, {FINDINGS} SELECT file, vd.verdict, round(confidence,6) confidence, string_agg(\"check\" || '=' || fd.verdict, ',' ORDER BY \"check\") findings FROM vd JOIN fd USING (file) GROUP BY ALL")
def log_verdicts(spark, sf_dir):
    """Integrity checks of each log and what they come to."""
    found = corpus.analysis(places.stored(logs(spark, sf_dir).records(), "records"))
    return found.select("file", "verdict", F.round("confidence", 6).alias("confidence"), F.array_join(F.transform("findings", lambda f: F.concat_ws("=", f["check"], f["verdict"])), ",").alias("findings"))
