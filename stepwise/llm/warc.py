"""Resolution of not-modified revisits in web archives.

A revisit record says that a page was fetched again and had not changed.  It is resolved by an as-of
join: the latest earlier full response with the same canonical URL.  The validators of both must not
contradict each other; then the revisit gets the response's body and headers, in which the headers
that a not-modified answer may update are replaced by the revisit's.

The as-of join runs in two steps, so that one URL with very many captures is no single task's work:
captures are cut into slices of time, the last response of each slice is passed on to the later
slices of its URL, and each slice is then joined by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers that a not-modified answer may update (HTTP semantics, section on 304).  Fixed values.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: URLs of more captures than this are cut into slices of time of about so many each, at most so many slices.
SLICE_ROWS, SLICES = 4_096, 512


def canonical_url(url: Column) -> Column:
    """Scheme, ``www.``, user, default port, fragment, trailing slash, index page, host's case, tracking
    parameters and the order of parameters don't distinguish URLs.  Null stays null."""
    text = F.regexp_replace(F.trim(url), "#.*$", "")
    text = F.regexp_replace(text, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(text, "^([^/?]*)", 1), "^[^@]*@", ""))
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), r"^www\.|\.$", "")
    path = F.regexp_extract(text, r"^[^/?]*([^?]*)", 1)
    path = F.regexp_replace(F.regexp_replace(path, r"/(index|default)\.[a-z]+$", "/"), "/+$", "")
    query = F.regexp_extract(text, r"\?(.*)$", 1)
    parts = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[a-z]*|gclid|fbclid|ref)(=|$)")))
    joined = F.array_join(parts, "&")
    return F.concat(host, path, F.when(joined == "", "").otherwise(F.concat(F.lit("?"), joined)))


def _lower_keys(headers: Column) -> Column:
    entries = F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>")))
    named = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("k"), e["value"].alias("v")))
    # of headers that differ in case only the last one counts
    keys = F.array_distinct(F.transform(named, lambda e: e["k"]))
    last = F.transform(keys, lambda k: F.element_at(F.filter(named, lambda e: e["k"] == k), -1)["v"])
    return F.map_from_arrays(keys, last)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Resolve the revisits among ``records``.

    ``records`` has record_id, kind (``response`` or ``revisit``), url, ts (orderable), status (int),
    headers (map of strings) and body.  Only responses of status 200 with a body can be resolved to.
    Returns a row for each revisit: record_id, url, ts, ``canonical``, ``source_id`` (the response, null
    if there is none), ``state`` (``resolved``, ``no-response`` or ``validator-mismatch``), ``headers``
    (merged if resolved, else the revisit's) and ``body`` (null unless resolved).

    The comparison is the weak one: if both have an ETag, these must be equal up to a ``W/`` mark; if not,
    and both have Last-Modified, these must be equal; with nothing to compare, a digest header
    (``warc-payload-digest``) of both must be equal where both have it.

    Cases: times are compared as their type is (text as text); a response at the revisit's own time counts
    as earlier only with a smaller record_id; a null record_id is smaller than all others and otherwise an
    id like them; of responses with one id, time and URL the one with the smallest SHA-256 of its body
    and then the smallest headers counts; null urls and times are never resolved; null headers are none;
    header names ignore case; rows that repeat are resolved one by one; an empty table gives an empty
    result; other columns, whatever their names, are ignored.
    """
    rows = records.select(
        "record_id", "kind", "url", "ts", "status", _lower_keys(F.col("headers")).alias("headers"), "body", canonical_url(F.col("url")).alias("canonical")
    )
    full = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("body").isNotNull()
    known = F.col("canonical").isNotNull() & F.col("ts").isNotNull()
    # the captures without their contents
    thin = rows.where(known & (full | (F.col("kind") == "revisit"))).select(
        "canonical", F.struct("ts", "record_id").alias("at"), F.when(full, F.struct("ts", "record_id")).alias("full")
    ).distinct()
    # The slices of a URL are about equal in number of captures.
    cuts = _slice_ends(thin)
    thin = thin.join(cuts, "canonical", "left").withColumn(
        "slice", F.when(F.col("ends").isNull(), 0).otherwise(F.size(F.filter("ends", lambda e: e < F.col("at"))))
    ).drop("ends")
    last = thin.groupBy("canonical", "slice").agg(F.max("full").alias("last"))
    earlier = Window.partitionBy("canonical").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select("canonical", "slice", F.max("last").over(earlier).alias("before"))
    inside = Window.partitionBy("canonical", "slice").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    found = (
        thin.withColumn("within", F.max("full").over(inside))
        .where(F.col("full").isNull())
        .join(last, ["canonical", "slice"])
        .select(F.col("canonical").alias("c"), F.col("at.record_id").alias("rid"), F.col("at.ts").alias("rts"), F.coalesce("within", "before").alias("source"))
    )
    revisits = rows.where(F.col("kind") == "revisit").drop("kind", "status", "body").withColumnRenamed("headers", "own")
    revisits = revisits.join(
        found, revisits["record_id"].eqNullSafe(found["rid"]) & (revisits["ts"] == found["rts"]) & (revisits["canonical"] == found["c"]), "left"
    ).drop("rid", "rts", "c")
    sources = rows.where(full & known).select(
        F.col("record_id").alias("sid"), F.col("ts").alias("sts"), F.col("canonical").alias("sc"), F.col("headers").alias("theirs"), F.col("body").alias("sbody")
    )
    order = F.struct(F.sha2(F.col("sbody").cast("binary"), 256), F.array_sort(F.map_entries("theirs")))
    sources = sources.groupBy("sid", "sts", "sc").agg(F.min_by(F.struct("theirs", "sbody"), order).alias("one")).select("sid", "sts", "sc", "one.*")
    joined = revisits.join(
        sources, F.col("source.record_id").eqNullSafe(F.col("sid")) & (F.col("source.ts") == F.col("sts")) & (F.col("canonical") == F.col("sc")), "left"
    )
    bare = lambda m: F.regexp_replace(F.col(m)["etag"], "^W/", "")
    same = (
        F.when(bare("own").isNotNull() & bare("theirs").isNotNull(), bare("own") == bare("theirs"))
        .when(
            F.col("own")["last-modified"].isNotNull() & F.col("theirs")["last-modified"].isNotNull(),
            F.col("own")["last-modified"] == F.col("theirs")["last-modified"],
        )
        .otherwise(F.coalesce(F.col("own")["warc-payload-digest"] == F.col("theirs")["warc-payload-digest"], F.lit(True)))
    )
    state = F.when(F.col("sbody").isNull(), "no-response").when(same, "resolved").otherwise("validator-mismatch")
    permitted = F.array(*map(F.lit, PERMITTED))
    update = F.map_filter("own", lambda k, v: F.array_contains(permitted, k))
    keep = F.map_filter("theirs", lambda k, v: ~F.array_contains(F.map_keys(update), k))
    joined = joined.withColumn("state", state)
    return joined.select(
        "record_id",
        "url",
        "ts",
        "canonical",
        F.col("sid").alias("source_id"),
        "state",
        F.when(F.col("state") == "resolved", F.map_concat(keep, update)).otherwise(F.col("own")).alias("headers"),
        F.when(F.col("state") == "resolved", F.col("sbody")).alias("body"),
    )


def _slice_ends(thin: DataFrame) -> DataFrame:
    """(canonical, ends): for each URL of more than ``SLICE_ROWS`` captures, captures that part its slices.

    They are chosen by their hashes, about as many as there are to be slices.  Whatever type times and ids
    have, a task holds no more of a URL than these.
    """
    large = thin.groupBy("canonical").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SLICE_ROWS)
    share = F.least(F.lit(float(SLICES)), F.col("n") / SLICE_ROWS) / F.col("n")
    mark = F.pmod(F.xxhash64("at", "canonical"), F.lit(1 << 30))
    chosen = thin.join(large, "canonical").where(mark < share * (1 << 30))
    return chosen.groupBy("canonical").agg(F.array_sort(F.collect_set("at")).alias("ends"))
