"""URL filters: captures against dated list entries, as of the time of each fetch. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Where a host stands in a lower-case URL (a backslash is read as a slash, as browsers do), and what none may hold.
_HOST = r"^\s*(?:[a-z][a-z0-9+.-]*:)?[/\\]{2}(?:[^/\\?#]*@)?(\[[0-9a-f:.]+\]|[^/\\:?#\[\]@\s]+)"
_NO_HOST = r"[\x00-\x20/\\:?#@%<>^|\[\]\x7f]"


def host(url: Column) -> Column:
    """A URL's host in lower case, without user, port and closing dots; an IPv6 address keeps its brackets. A URL may begin with
    its slashes; backslashes count as slashes; percent-encoded characters are decoded. Null if there is no host, or one that is
    none once decoded."""

    def decoded(found: Column) -> Column:
        plain = F.lower(F.try_url_decode(F.replace(found, F.lit("+"), F.lit("%2b"))))
        known = F.when(~F.contains(found, F.lit("%")), found).when(~plain.rlike(_NO_HOST), plain)
        return F.nullif(F.regexp_replace(known, r"\.+$", ""), F.lit(""))

    return F.transform(F.array(F.regexp_extract(F.lower(url), _HOST, 1)), decoded)[0]  # extracted once, however often it is named


def parents(name: Column) -> Column:
    """A host and the domains it lies in, as an array from the whole name on, but for the last label alone: no entry lists a whole
    top-level domain. An address lies in none but itself."""
    labels = F.split(name, r"\.")
    every = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.when(name.rlike(r"^(\[.*|[0-9.]+)$"), F.array(name)).otherwise(every)


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals of list entries (domain, day, seq, action 'add' or 'remove', category): domain, category, valid_from,
    valid_to (not included; null while it goes on).

    Of a domain's entries on one day the last (by seq) holds. An addition is valid until the domain's next entry. Entries
    without domain or day are left out. A domain has at most one row a day here, so a window over it is small however
    many entries it has.
    """
    daily = entries.filter("domain IS NOT NULL AND day IS NOT NULL").groupBy("domain", "day").agg(F.max_by(F.struct("action", "category"), "seq").alias("e"))
    following = F.lead("day").over(Window.partitionBy("domain").orderBy("day"))
    timed = daily.select("domain", F.col("e.action").alias("action"), F.col("e.category").alias("category"), F.col("day").alias("valid_from"), following.alias("valid_to"))
    return timed.filter("action = 'add'").drop("action")


def listed_as_of(captures: DataFrame, entries: DataFrame, last_day: Column) -> DataFrame:
    """Add category, valid_from and listed (boolean) to captures (with columns domain and fetched, a date): the list entry that was
    valid for the domain, or the nearest one it lies in, when each was fetched. ``last_day`` is the last day that any capture has.

    Intervals are cut at months, and captures meet them on domain and month, so a popular domain is dealt over as many keys
    as there are months, with no more than 31 intervals each. A capture meets an interval in one task for each of its domains,
    and the nearest is an aggregate by capture. Captures without domain or date are listed nowhere; repeated rows stay; columns of
    captures that are called as those added or those of the entries are theirs; empty tables give empty tables.
    """
    month = lambda d: F.trunc(d, "month")
    last = F.coalesce(F.date_sub("valid_to", 1), F.greatest(last_day, F.col("valid_from")))
    cut = F.explode(F.sequence(month(F.col("valid_from")), month(last), F.expr("interval 1 month")))
    spans = intervals(entries).select(F.col("domain").alias("_domain"), F.struct("valid_from", "valid_to", "category").alias("_span"), cut.alias("_month"))
    own = [c for c in captures.columns if c not in ("category", "valid_from", "listed")]
    rows = captures.select(F.struct(*own).alias("_own"), F.monotonically_increasing_id().alias("_row"))
    each = rows.select("_own", "_row", F.posexplode_outer(parents(F.col("_own.domain"))).alias("_up", "_domain"), month(F.col("_own.fetched")).alias("_month"))
    met = each.join(spans, ["_domain", "_month"], "left")
    valid = (F.col("_own.fetched") >= F.col("_span.valid_from")) & (F.col("_span.valid_to").isNull() | (F.col("_own.fetched") < F.col("_span.valid_to")))
    nearest = F.min(F.when(valid, F.struct("_up", F.col("_span.category").alias("category"), F.col("_span.valid_from").alias("valid_from")))).alias("_entry")
    found = met.groupBy("_row").agg(F.first("_own").alias("_own"), nearest)
    return found.select("_own.*", "_entry.category", "_entry.valid_from", F.col("_entry").isNotNull().alias("listed"))


def _once(value: Column) -> Column:
    """``value`` generated, not projected, so that later steps that name it don't compute it again each time."""
    return F.explode(F.array(value))


def _day(factor: int) -> Column:
    """A day in 2024 that follows from page_id, whatever its size; null without one."""
    return F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.pmod(F.col("page_id"), F.lit(366)) * factor, F.lit(366)).cast("int"))


def captures_of(pages: DataFrame) -> DataFrame:
    """The synthetic pages as captures: page_id, url, domain (the host), and a fetch date in 2024 that follows from page_id."""
    return pages.select("page_id", "url", _once(host(F.col("url"))).alias("domain"), _day(7919).alias("fetched"))


def entries_of(pages: DataFrame) -> DataFrame:
    """A dated block list that follows from the pages: every fifth one has its host, or the domain that lies in, added or (one time
    in three) removed."""
    listed = parents(F.col("_host"))
    return pages.filter("page_id % 5 = 0").select("page_id", _once(host(F.col("url"))).alias("_host")).select(
        F.when((F.col("page_id") % 4 == 0) & (F.size(listed) > 1), F.get(listed, F.lit(1))).otherwise(F.get(listed, F.lit(0))).alias("domain"),
        _day(104729).alias("day"),
        F.col("page_id").alias("seq"),
        F.expr("CASE WHEN page_id % 3 = 0 THEN 'remove' ELSE 'add' END").alias("action"),
        F.expr("CASE WHEN page_id % 2 = 0 THEN 'spam' ELSE 'gambling' END").alias("category"),
    )


def filter_pages(pages: DataFrame) -> DataFrame:
    """Every page with the list entry valid when it was fetched: page_id, domain, fetched, listed, category, listed_since. A null
    page_id has no date and is listed nowhere; rows that come again stay."""
    listed = listed_as_of(captures_of(pages), entries_of(pages), F.lit("2024-12-31").cast("date"))
    return listed.select("page_id", "domain", F.col("fetched").cast("string").alias("fetched"), "listed", "category", F.col("valid_from").cast("string").alias("listed_since"))


ORACLE_SQL = r"""
WITH p AS (
  SELECT page_id, row_number() OVER () AS r, nullif(regexp_replace(CASE WHEN NOT contains(h, '%') THEN h WHEN NOT regexp_matches(lower(url_decode(h)), '[\x00-\x20/\\:?#@%<>^|\[\]\x7f]') THEN lower(url_decode(h)) END, '\.+$', ''), '') AS host
  FROM (SELECT page_id, regexp_extract(lower(url), '^\s*(?:[a-z][a-z0-9+.-]*:)?[/\\]{2}(?:[^/\\?#]*@)?(\[[0-9a-f:.]+\]|[^/\\:?#\[\]@\s]+)', 1) AS h FROM pages)
), lists AS (
  SELECT *, CASE WHEN regexp_matches(host, '^(\[.*|[0-9.]+)$') THEN [host] ELSE list_transform(range(1, greatest(len(string_split(host, '.')), 2)), lambda i: array_to_string(string_split(host, '.')[i:], '.')) END AS domains FROM p
), captures AS (
  SELECT r, page_id, host, domains, DATE '2024-01-01' + CAST((page_id * 7919) % 366 AS INTEGER) AS fetched FROM lists
), ups AS (
  SELECT r, fetched, unnest(domains) AS domain, unnest(range(len(domains))) AS up FROM captures
), entries AS (
  SELECT CASE WHEN page_id % 4 = 0 AND len(domains) > 1 THEN domains[2] ELSE domains[1] END AS domain, DATE '2024-01-01' + CAST((page_id * 104729) % 366 AS INTEGER) AS day, page_id AS seq,
         CASE WHEN page_id % 3 = 0 THEN 'remove' ELSE 'add' END AS action,
         CASE WHEN page_id % 2 = 0 THEN 'spam' ELSE 'gambling' END AS category
  FROM lists WHERE page_id % 5 = 0 AND host IS NOT NULL
), daily AS (
  SELECT * FROM entries QUALIFY row_number() OVER (PARTITION BY domain, day ORDER BY seq DESC) = 1
), timed AS (
  SELECT *, lead(day) OVER (PARTITION BY domain ORDER BY day) AS until FROM daily
), hits AS (
  SELECT u.r, u.up, t.day, t.category FROM ups u JOIN timed t ON t.action = 'add' AND t.domain = u.domain AND u.fetched >= t.day AND (t.until IS NULL OR u.fetched < t.until)
  QUALIFY row_number() OVER (PARTITION BY u.r ORDER BY u.up) = 1
)
SELECT c.page_id, c.host AS domain, CAST(c.fetched AS VARCHAR) AS fetched, h.day IS NOT NULL AS listed, h.category, CAST(h.day AS VARCHAR) AS listed_since
FROM captures c LEFT JOIN hits h USING (r)
"""
