"""Checks of the archive itself: its entries, the headers of its tables, and how their rows and cells were written.

Entries and headers are small lists that the driver holds already (`Feed.members`, `Feed.headers`); rows and cells are one
aggregate a table, whose row of figures becomes at most one finding a rule and file. Where a cell's form decides, the row's
cells are tried together first, and one by one only in rows that such a form may be in. Cells beyond the header's are not
looked into; their row is a finding of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timetide.functions.macros import expand
from timetide.plans.config import Config
from timetide.plans.views import COLUMNS
from timetide.sources.feed import ROW, Feed

# Required files, calendar files, required columns, columns beyond those that checks name, columns of ids.
REQUIRED = ("agency", "stops", "routes", "trips", "stop_times")
CALENDARS = ("calendar", "calendar_dates")
REQUIRED_COLUMNS = {
    "agency": "agency_name agency_url agency_timezone",
    "stops": "stop_id",
    "routes": "route_id route_type",
    "trips": "route_id service_id trip_id",
    "stop_times": "trip_id stop_sequence",
    "calendar": "service_id monday tuesday wednesday thursday friday saturday sunday start_date end_date",
    "calendar_dates": "service_id date exception_type",
    "shapes": "shape_id shape_pt_lat shape_pt_lon shape_pt_sequence",
    "frequencies": "trip_id start_time end_time headway_secs",
    "transfers": "transfer_type",
    "fare_attributes": "fare_id price currency_type payment_method transfers",
    "fare_rules": "fare_id",
    "pathways": "pathway_id from_stop_id to_stop_id pathway_mode is_bidirectional",
    "levels": "level_id level_index",
    "feed_info": "feed_publisher_name feed_publisher_url feed_lang",
    "translations": "table_name field_name language translation",
    "rider_categories": "rider_category_id rider_category_name is_default_fare_category",
    "fare_media": "fare_media_id fare_media_type",
    "fare_products": "fare_product_id amount currency",
    "fare_leg_rules": "fare_product_id",
    "fare_leg_join_rules": "from_network_id to_network_id",
    "fare_transfer_rules": "fare_transfer_type",
    "areas": "area_id",
    "stop_areas": "area_id stop_id",
    "networks": "network_id",
    "timeframes": "timeframe_group_id service_id",
    "booking_rules": "booking_rule_id booking_type",
    "location_groups": "location_group_id",
    "location_group_stops": "location_group_id stop_id",
    "attributions": "organization_name",
    "route_networks": "network_id route_id",
}
FURTHER_COLUMNS = {
    "stop_times": "pickup_booking_rule_id drop_off_booking_rule_id timepoint",
    "pathways": "reversed_signposted_as",
    "attributions": "attribution_phone",
    "booking_rules": "message pickup_message drop_off_message",
    "agency_jp": "agency_official_name agency_zip_number agency_address agency_president_pos agency_president_name",
    "routes_jp": "route_update_date origin_stop via_stop destination_stop",
    "office_jp": "office_url office_phone",
    "pattern_jp": "origin_stop via_stop destination_stop",
}
NOT_OF_THE_FORMAT = {"fare_attributes": "ic_price"}
ID_COLUMNS = set(
    "agency_id stop_id parent_station zone_id level_id route_id network_id trip_id service_id block_id shape_id fare_id origin_id "
    "destination_id contains_id from_stop_id to_stop_id from_route_id to_route_id from_trip_id to_trip_id pathway_id area_id "
    "from_area_id to_area_id fare_media_id fare_product_id leg_group_id from_leg_group_id to_leg_group_id rider_category_id "
    "timeframe_group_id from_timeframe_group_id to_timeframe_group_id location_group_id location_id booking_rule_id "
    "pickup_booking_rule_id drop_off_booking_rule_id prior_notice_service_id".split()
)
TAGS = (
    "a abbr address area article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col "
    "colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame "
    "frameset h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark marquee meta "
    "meter nav nobr noscript object ol optgroup option output p param picture pre progress q s samp script section select small "
    "source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt "
    "u ul var video wbr"
).split()

#: Unknown columns of a file that are listed one by one; the others are one finding with their number.
MOST_UNKNOWN = 100

_BAD = r"[\x00-\x08\x0E-\x1F\x7F\x{E000}-\x{F8FF}\x{FFF0}-\x{FFFF}]"
_MARKUP = rf"<!--|</?(?i:{'|'.join(TAGS)})(?:[\s/][^<>]*)?>|&(?:[A-Za-z][A-Za-z0-9]{{1,6}}|#[0-9]{{1,6}}|#[xX][0-9A-Fa-f]{{1,5}});"
_PADDED = r"(^|,)[\s\p{Z}]|[\s\p{Z}](,|$)"
SCHEMA = "rule_id string, entity_type string, entity_id string, scope_key string, file string, line long, field string, observed_value string, instances long"


def _found(rule: str, file: str | None, line: int | None = None, field: str | None = None, seen: object = None) -> tuple:
    return rule, "file" if file else "feed", file, None, file, line, field, None if seen is None else str(seen), 1


def known(table: str) -> set[str]:
    return set(f"{COLUMNS.get(table, '')} {FURTHER_COLUMNS.get(table, '')}".split()) - set(NOT_OF_THE_FORMAT.get(table, "").split())


def header_findings(table: str, first: list[str], bom: bool) -> list[tuple]:
    """Findings of one table's header row, as it was written."""
    file, names, out = f"{table}.txt", [c.strip() for c in first], []
    if bom:
        out.append(_found("ARC_010", file, None, None, "UTF-8 BOM (EF BB BF)"))
    out += [_found("ARC_014", file, 1, c, f'"{c}"') for c in first if c != c.strip()]
    if "" in names:
        out.append(_found("ARC_019", file, 1, None, '""'))
    out += [_found("ARC_015", file, 1, c, c) for i, c in enumerate(names) if c in names[:i]]
    unknown = [c for c in names if c not in known(table) and not c.startswith("jp_")]
    out += [_found("ARC_017", file, 1, c, c) for c in unknown[:MOST_UNKNOWN]]
    if len(unknown) > MOST_UNKNOWN:
        out.append(_found("ARC_017", file, 1, None, len(unknown) - MOST_UNKNOWN))
    needed = REQUIRED_COLUMNS.get(table, "").split()
    if table == "stop_times" and not {"location_group_id", "location_id"} & set(names):
        needed = [*needed, "stop_id"]
    return out + [_found("ARC_025", file, 1, c, "") for c in needed if c not in names]


def member_findings(feed: Feed, config: Config) -> list[tuple]:
    """Findings of the entries of the archive and of the files that are there or not."""
    out = []
    present = set(feed.tables) | {m["table"].removesuffix(".txt") for m in feed.members or [] if m["table"]}
    zones = any(m["name"].rsplit("/", 1)[-1] == "locations.geojson" for m in feed.members or [])
    for m in feed.members or []:
        name, table, base = m["name"], m["table"].removesuffix(".txt"), m["name"].rsplit("/", 1)[-1]
        if name.endswith("/") or name.startswith("__MACOSX/") or base in (".DS_Store", "Thumbs.db"):
            continue
        if name.endswith(".txt") and "/" in name:
            out.append(_found("ARC_024", name, None, None, name))
        if name.endswith(".txt") and m["mode"] and not m["mode"] & 0o400:
            out.append(_found("ARC_027", name, None, None, f"{m['mode']:o}"))
        if name.endswith(".zip"):
            out.append(_found("ARC_023", name, None, None, name))
        elif table:
            out.append(_found("ARC_011", m["table"], None, None, f"{m['bytes']} bytes"))
            if table not in COLUMNS:
                out.append(_found("ARC_007", m["table"], None, None, m["table"]))
            elif table not in REQUIRED:
                out.append(_found("ARC_006", m["table"]))
        elif base != "locations.geojson" and ("/" not in name or base.lower().rsplit(".", 1)[0] in COLUMNS) and not name.endswith(".txt"):
            out.append(_found("ARC_007", name, None, None, name))
    if feed.members is not None and (n := sum(m["differs"] for m in feed.members)):
        out.append(_found("ARC_036", None, None, None, n))
    for table in REQUIRED:
        if table not in present and not (table == "stops" and zones):
            out.append(_found("ARC_004", f"{table}.txt", None, None, f"{table}.txt"))
    if not present & set(CALENDARS):
        out.append(_found("ARC_008", None))
    if "translations" in present and "feed_info" not in present:
        out.append(_found("ARC_031", None))
    for table in sorted(present - set(feed.tables)):  # a file without even a header row
        paired = table in CALENDARS and set(CALENDARS) <= present
        if table in REQUIRED and not (table == "stops" and zones):
            out.append(_found("ARC_035", f"{table}.txt", None, None, f"{table}.txt"))
        elif table in COLUMNS and not paired:
            out.append(_found("ARC_009", f"{table}.txt"))
    if config.source_url and not config.source_url.split("?")[0].split("#")[0].lower().endswith(".zip"):
        out.append(_found("ARC_028", None, None, None, config.source_url))
    return out


def _first_sign(cells: Column, form: str) -> Column:
    """The first character of that form, as U+XXXX."""
    return F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(F.regexp_extract(cells, form, 0))), 4, "0"))


def table_findings(table: str, feed: Feed, config: Config) -> DataFrame:
    """Findings of the rows and cells of one table: one pass, one row of figures, one finding a rule that has any.

    rule_id and so on, `affected` (rows) and `severity` (Info for rows that only leave out cells at their end, else null).
    """
    rows, header, file = feed.rows[table], feed.headers[table], f"{table}.txt"
    names = [c for c in rows.columns if c not in ("line", ROW)]
    row = lambda x: F.col(f"`{ROW}`.{x}")
    cell = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(""))
    together = lambda cs: F.concat_ws(",", *[F.col(f"`{c}`") for c in cs]) if cs else F.lit("")
    trimmed = lambda c: F.expr(expand("trimmed(__c)").replace("__c", f"`{c}`"))
    ids = [c for c in names if c in ID_COLUMNS]
    marked = [c for c in names if c != "tts_stop_name"]
    data = row("kind") == "data"
    every = together(names)
    may = {"DQ_016": every.rlike(_PADDED), "ARC_032": together(marked).rlike("[<&]"), "ARC_037": together(ids).rlike(r"[^\x00-\x7F]")}
    cellwise = {
        "DQ_016": {c: cell(c) != F.coalesce(trimmed(c), F.lit("")) for c in names},
        "ARC_032": {c: cell(c).rlike(_MARKUP) for c in marked},
        "ARC_037": {c: cell(c).rlike(r"[^\x00-\x7F]") for c in ids},
    }
    none = F.lit(None).cast("string")
    # Columns at fault in a row, as an array; most rows skip the cells.
    at_fault = {r: F.when(data & may[r], F.array_compact(F.array(*[F.when(hit, F.lit(c)) for c, hit in cs.items()]))) if cs else F.lit(None).cast("array<string>") for r, cs in cellwise.items()}
    shaped = rows.select(
        "line", row("kind").alias("kind"), row("cells").alias("n"), row("valid").alias("valid"), row("quoting").alias("quoting"), row("bare_cr").alias("bare_cr"),
        F.when(data, every).alias("every"), *[at_fault[r].alias(r) for r in at_fault],
        *[F.coalesce(*[F.when(hit, F.col(f"`{c}`")) for c, hit in cellwise[r].items()], none).alias(f"{r}_seen") if r == "ARC_037" and cellwise[r] else none.alias(f"{r}_seen") for r in at_fault],
    )
    of = F.col
    conditions = {
        "ARC_012 long": of("n") > len(header),
        "ARC_012 short": of("n") < len(header),
        "ARC_013": of("quoting") == "open",
        "ARC_021": of("every").rlike(_BAD),
        "ARC_026": of("bare_cr"),
        "ARC_030": of("every").rlike(r"[\t\r\n]"),
        "ARC_033": of("quoting") == "quote",
        **{r: F.size(r) > 0 for r in at_fault},
        "ARC_002": ~of("valid"),
    }
    seen = {"ARC_021": _first_sign(of("every"), _BAD), "ARC_030": _first_sign(of("every"), r"[\t\r\n]"), "ARC_037": of("ARC_037_seen")}
    figures = [F.count_if(of("kind") == "data").alias("data")]
    for r, condition in conditions.items():
        hit = F.when(condition, of("line"))
        figures.append(F.struct(F.count(hit).alias("n"), F.min(hit).alias("line"), F.min_by(seen[r], hit).alias("seen") if r in seen else none.alias("seen")).alias(r))
    for r, cs in cellwise.items():
        figures += [F.max(F.array_contains(r, c)).alias(f"{r} {c}") for c in cs]
    got = shaped.agg(*figures)

    first = feed.first.get(table, {"valid": True, "bare_cr": False})
    bad_head = {"ARC_002": not first["valid"], "ARC_026": bool(first["bare_cr"])}
    fields = {r: F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(of(f"`{r} {c}`"), F.lit(c)) for c in cs]))), ", ") if cs else none for r, cs in cellwise.items()}

    def finding(rule: str, when: Column, line: Column, field: Column, observed: Column, affected: Column, severity: str | None = None) -> Column:
        values = dict(rule_id=F.lit(rule), entity_type=F.lit("file"), entity_id=F.lit(file), scope_key=none, file=F.lit(file), line=line.cast("long"), field=field, observed_value=observed.cast("string"), instances=F.lit(1).cast("long"), affected=affected.cast("long"), severity=F.lit(severity).cast("string"))
        return F.when(when, F.struct(*[v.alias(k) for k, v in values.items()]))

    no_line, n = F.lit(None), lambda r: of(f"`{r}`.n")
    at = lambda r: of(f"`{r}`.line")
    # Of a table that is not UTF-8, or whose last cell never closes, nothing else is told.
    broken = (n("ARC_002") > 0) | F.lit(bad_head["ARC_002"])
    readable = ~broken & (n("ARC_013") == 0)
    whole = {"ARC_002": F.lit(True), "ARC_026": F.lit(True), "ARC_013": ~broken}
    hit = lambda r: ((n(r) > 0) | F.lit(bad_head.get(r, False))) & whole.get(r, readable)
    out = [
        finding("ARC_012", hit("ARC_012 long"), no_line, none, n("ARC_012 long"), n("ARC_012 long")),
        finding("ARC_012", hit("ARC_012 short"), no_line, none, n("ARC_012 short"), n("ARC_012 short"), "Info"),
        finding("ARC_013", hit("ARC_013"), no_line, none, F.lit("issue=unclosed_quote"), n("ARC_013")),
        finding("ARC_021", hit("ARC_021"), at("ARC_021"), none, of("ARC_021.seen"), n("ARC_021")),
        finding("ARC_026", hit("ARC_026"), no_line, none, F.lit("CR not followed by LF"), n("ARC_026")),
        finding("ARC_030", hit("ARC_030"), at("ARC_030"), none, of("ARC_030.seen"), n("ARC_030")),
        finding("ARC_033", hit("ARC_033"), at("ARC_033"), none, F.concat(F.lit("rows="), n("ARC_033").cast("string")), n("ARC_033")),
        finding("ARC_002", hit("ARC_002"), no_line, none, none, n("ARC_002")),
        finding("ARC_022", readable & (of("data") > config.max_file_rows), no_line, none, of("data"), of("data")),
        finding("DQ_016", hit("DQ_016"), at("DQ_016"), fields["DQ_016"], n("DQ_016"), n("DQ_016")),
        finding("ARC_032", hit("ARC_032"), at("ARC_032"), fields["ARC_032"], n("ARC_032"), n("ARC_032")),
        finding("ARC_037", hit("ARC_037"), at("ARC_037"), fields["ARC_037"], of("ARC_037.seen"), n("ARC_037")),
    ]
    if table not in REQUIRED:
        out.append(finding("ARC_003", hit("ARC_002"), no_line, none, none, n("ARC_002")))
    zones = any(m["name"].rsplit("/", 1)[-1] == "locations.geojson" for m in feed.members or [])
    if table in REQUIRED and not (table == "stops" and zones):
        out.append(finding("ARC_035", readable & (of("data") == 0), no_line, none, F.lit(file), F.lit(1)))
    elif table not in REQUIRED and not (table in CALENDARS and set(CALENDARS) <= set(feed.tables)):
        out.append(finding("ARC_009", readable & (of("data") == 0), no_line, none, none, F.lit(1)))
    return got.select(F.explode(F.array_compact(F.array(*out))).alias("f")).select("f.*")


def row_findings(table: str, feed: Feed) -> DataFrame:
    """Rows that are empty, and headers that come again as rows; rows of a table don't have them any more."""
    kind = F.col(f"`{ROW}`.kind")
    none = F.lit(None).cast("string")
    odd = feed.rows[table].filter(kind != "data")
    rule = F.when(kind == "empty", "ARC_018").otherwise("ARC_034")
    file = F.lit(f"{table}.txt")
    return odd.select(rule.alias("rule_id"), F.lit("file").alias("entity_type"), file.alias("entity_id"), none.alias("scope_key"), file.alias("file"), "line", none.alias("field"), none.alias("observed_value"), F.lit(1).cast("long").alias("instances"))


def jobs(feed: Feed, config: Config, rules: set[str]) -> list:
    """Functions that give findings of those rules as parts of the notices table: one for each table, and one for what the driver holds."""

    def listed() -> list[DataFrame]:
        found = [_found(feed.fatal, None)] if feed.fatal else member_findings(feed, config)
        for table, first in feed.first.items():
            if table in COLUMNS and not feed.fatal:
                found += header_findings(table, first["cells"], first["bom"])
        return [feed.spark.createDataFrame([f for f in found if f[0] in rules], SCHEMA)]

    def of(table: str) -> list[DataFrame]:
        parts = [table_findings(table, feed, config)] if rules & _OF_TABLES else []
        parts += [row_findings(table, feed)] if rules & {"ARC_018", "ARC_034"} else []
        return [p.filter(F.col("rule_id").isin(*sorted(rules))) for p in parts]

    return [listed, *(lambda table=t: of(table) for t in feed.rows if t in COLUMNS and not feed.fatal)]


_OF_TABLES = set("ARC_002 ARC_003 ARC_009 ARC_012 ARC_013 ARC_021 ARC_022 ARC_026 ARC_030 ARC_032 ARC_033 ARC_035 ARC_037 DQ_016".split())
