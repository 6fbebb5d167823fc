"""Ships, aircraft, airports, border posts, map features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AIS = """MessageType string, MetaData struct<MMSI:bigint,ShipName:string,time_utc:string>, Message struct<
 PositionReport:struct<Latitude:double,Longitude:double,Sog:double,Cog:double,TrueHeading:int,NavigationalStatus:int>,
 StandardClassBPositionReport:struct<Latitude:double,Longitude:double,Sog:double,Cog:double,TrueHeading:int,NavigationalStatus:int>,
 ShipStaticData:struct<Name:string,ImoNumber:bigint,CallSign:string,Type:int,Destination:string,MaximumStaticDraught:double,Dimension:struct<A:int,B:int>>>"""


def wanted_type(kind: Column, ranges=((60, 69), (70, 79), (80, 89))) -> Column:
    """Ship types worth keeping (FLT16)."""
    out = F.lit(False)
    for a, z in ranges:
        out = out | kind.between(a, z)
    return out


def ais(messages: DataFrame) -> DataFrame:
    """mmsi, at, kind and the fields of a position or static report (SRC28; column json). Works on streams too.

    Positions at (0, 0) or outside the globe drop; heading 511 means none; static reports of unwanted types drop."""
    m = messages.select(F.from_json("json", AIS).alias("m")).select("m.*")
    p = F.coalesce("Message.PositionReport", "Message.StandardClassBPositionReport")
    s = F.col("Message.ShipStaticData")
    clean = lambda c: F.nullif(F.trim(F.regexp_replace(c, "[@\\s]+", " ")), F.lit(""))
    out = m.select(
        F.col("MetaData.MMSI").alias("mmsi"), F.to_timestamp(F.substring("MetaData.time_utc", 1, 19)).alias("at"), F.when(s.isNotNull(), "static").when(p.isNotNull(), "position").alias("kind"),
        p["Latitude"].alias("lat"), p["Longitude"].alias("lon"), p["Sog"].alias("sog"), p["Cog"].alias("cog"), F.nullif(p["TrueHeading"], F.lit(511)).alias("heading"),
        clean(F.coalesce(s["Name"], F.col("MetaData.ShipName"))).alias("name"), F.nullif(s["ImoNumber"], F.lit(0)).alias("imo"), s["Type"].alias("ship_type"),
        F.nullif(F.coalesce(s["Dimension"]["A"], F.lit(0)) + F.coalesce(s["Dimension"]["B"], F.lit(0)), F.lit(0)).alias("length_m"), clean(s["Destination"]).alias("destination"),
    )
    on_globe = (F.abs("lat") <= 90) & (F.abs("lon") <= 180) & ~((F.col("lat") == 0) & (F.col("lon") == 0))
    kept = F.when(F.col("kind") == "position", on_globe).otherwise(F.col("ship_type").isNull() | wanted_type(F.col("ship_type")))
    return out.filter((F.coalesce("mmsi", F.lit(0)) != 0) & F.col("kind").isNotNull() & kept)


def cargo_planes(states: DataFrame, airlines: DataFrame) -> DataFrame:
    """Aircraft of cargo airlines with a position (SRC29). airlines: prefix, operator (a small table)."""
    s = states.withColumn("callsign", F.upper(F.trim("callsign"))).withColumn("prefix", F.substring("callsign", 1, 3))
    s = s.join(airlines, "prefix").filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return s.select("icao24", "callsign", "operator", "lat", "lon", F.coalesce("geo_altitude", "baro_altitude").alias("altitude"), (F.coalesce("velocity", F.lit(0.0)) * 1.943844).alias("knots"))


def airports(rows: DataFrame) -> DataFrame:
    """Large airports and medium ones with scheduled service (SRC25); code: the first of icao, gps and ident."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    keep = (F.col("type") == "large_airport") | ((F.col("type") == "medium_airport") & (F.col("scheduled_service") == "yes"))
    return rows.filter(keep).select(F.coalesce(blank("icao_code"), blank("gps_code"), F.col("ident")).alias("code"), "name", "type")


def crossings(waits: DataFrame, towns: DataFrame) -> DataFrame:
    """crossing, lat, lon: border posts placed at a town on their border (SRC27).

    A name's variants, the whole and its parts at commas, dashes and brackets, are looked up longest first."""
    parts = F.filter(F.transform(F.split(F.lower("name"), r"\s*[-,/()]\s*"), lambda x: F.trim(x)), lambda x: F.length(x) > 2)
    v = waits.select("crossing", "border", F.explode(F.array_distinct(F.concat(F.array(F.lower("name")), parts))).alias("variant"))
    j = v.join(towns.select(F.lower("town").alias("variant"), F.col("border").alias("b"), "lat", "lon"), "variant").filter("border = b")
    r = F.row_number().over(Window.partitionBy("crossing").orderBy(F.desc(F.length("variant")), "variant", "lat", "lon"))
    return j.withColumn("r", r).filter("r = 1").select("crossing", "lat", "lon")


#: Ship types by their tens, and navigation states: fixed values of the AIS standard.
SHIP_KINDS = {3: "special craft", 4: "high speed craft", 5: "special craft", 6: "passenger", 7: "cargo", 8: "tanker", 9: "other"}
NAVIGATION = {
    0: "under way", 1: "at anchor", 2: "not under command", 3: "restricted in how it can move", 4: "constrained by its draught",
    5: "moored", 6: "aground", 7: "fishing", 8: "under way sailing",
}
#: Hazard classes of cargo ships and tankers, by the last digit of their type.
HAZARDS = {1: "A", 2: "B", 3: "C", 4: "D"}


def ship_label(kind: Column) -> Column:
    """What a ship type reads as (SF27): cargo ships and tankers with their hazard class, passenger ships, else the bare number."""
    tens, last = F.floor(kind / 10), kind % 10
    base = F.when(tens == 7, "cargo ship").when(tens == 8, "tanker").when(tens == 6, "passenger ship")
    hazard = F.when(tens.isin(7, 8), label(last, HAZARDS))
    named = F.when(hazard.isNotNull(), F.concat(base, F.lit(", hazardous goods ("), hazard, F.lit(")"))).otherwise(base)
    return F.coalesce(named, F.concat(F.lit("AIS type "), kind.cast("string")), F.lit("type not yet known"))


def label(code: Column, names: dict) -> Column:
    """A code's name by map lookup (SF27); null where the map has none."""
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[code.cast("int")]


def feature_class(properties: Column, tags: dict[str, str], names: list[tuple[str, str]], fills: dict[str, str]) -> Column:
    """category of a map feature (SRC19): by a tag in its description, else by patterns of its name in order, else by fill."""
    p = lambda k: F.coalesce(F.get_json_object(properties, f"$.{k}"), F.lit(""))
    out = None
    for tests in ([(p("description").contains(k), v) for k, v in tags.items()], [(p("name").rlike(k), v) for k, v in names], [(F.lower(p("fill")) == k, v) for k, v in fills.items()]):
        for test, value in tests:
            out = F.when(test, value) if out is None else out.when(test, value)
    return out


def icon_bearing(icon: Column) -> Column:
    """Degrees of a numbered arrow icon: number x 22.5."""
    return (F.regexp_extract(icon, r"(\d+)", 1).try_cast("int") * 22.5) % 360


def control_marks(source: DataFrame) -> DataFrame:
    """lat, lon, mark, size, label of the marks in a Lua map module (SRC21; column text)."""
    each = source.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?s)\{\s*(lat\s*=.*?)\}"), F.lit(1))).alias("x"))
    number = lambda k: F.regexp_extract("x", rf"\b{k}\s*=\s*\"?(-?[0-9.]+)", 1).try_cast("double")
    text = lambda k: F.nullif(F.regexp_extract("x", rf"\b{k}\s*=\s*\"([^\"]*)\"", 1), F.lit(""))
    return each.select(number("lat").alias("lat"), number("long").alias("lon"), text("mark").alias("mark"), number("marksize").alias("size"), text("label").alias("label")).filter("lat is not null and lon is not null")
