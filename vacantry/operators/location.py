"""Resolving free-text places against a gazetteer: once for each distinct text, as attempts that look aliases up by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import REMOTE_MARKERS, fold_unicode
from ..session import checkpointed
from ..sources import state
from .gazetteer import prepared

CURRENT_VERSION = "v3"
_EDGE = " .,-"
#: Words that name no place although a place bears them, once `area` is gone.
DESCRIPTORS = [
    "bay", "metro", "valley", "delta", "north", "south", "east", "west", "central", "greater", "downtown", "uptown", "tri-state",
    "shore", "piedmont", "gold coast", "highlands", "north shore",
]
#: Fixed value: the pattern of words that say how or where one works, not in which place.
NOISE = r"\b(?:\d+\s*locations?|in\s+office|on\s+site|onsite|headquarters|hq|office|offices|location|hybrid|distributed|tbd|global|nationwide|n/a|multiple\s+(?:cities|locations)|home\s+based|emea|apac|americas|latin\s+america|north\s+america|europe|any|ceo)\b"
#: The patterns of a suffix that widens a place, a two-letter prefix, a two-letter end and a postal code.
AREA, METRO, PREFIX, TRAILING, ZIP = r"\s+area$", r"\s+metro(?:politan|politain)?$", r"^([a-z]{2})\s*-\s*(.+)$", r"^(.+)\s+([a-z]{2})$", r"\s+\d{5}(?:\s?\d{4})?$"
#: Keys that are null are dealt over so many values that nothing has.
NULL_SALTS = 1024
RESULT = "struct<city:string,region:string,country:string,resolved:boolean>"


def _strip(c: Column, chars: str = _EDGE) -> Column:
    return F.btrim(c, F.lit(chars))


def clean_place(c: Column, folded: bool = False) -> Column:
    """NFKC, folded case, no full stops, single spaces, no punctuation at the ends; null becomes ''."""
    c = c if folded else fold_unicode(c)
    return _strip(F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("."), F.lit("")), r"(?U)\s+", " "))


def first_place(c: Column) -> Column:
    """The head of a text that names several places: before ` or `, else before `/`."""
    return F.when(c.contains(" or "), _strip(F.substring_index(c, " or ", 1))).when(c.contains("/"), _strip(F.substring_index(c, "/", 1))).otherwise(c)


def strip_area(c: Column) -> Column:
    """Without a last `area`, and then without `metro` and the like if something is left."""
    bare = F.regexp_replace(c, AREA, "")
    short = F.regexp_replace(bare, METRO, "")
    return F.when(bare == c, c).when(short != "", short).otherwise(bare)


def strip_remote(c: Column) -> Column:
    for marker in REMOTE_MARKERS:
        c = F.replace(c, F.lit(marker), F.lit(" "))
    return _strip(F.regexp_replace(c, r"[\s\-–—]+", " "), " -–—,.")


def strip_noise(c: Column) -> tuple[Column, Column]:
    """(text, removed): without noise words, and whether there were any."""
    out = _strip(F.regexp_replace(F.regexp_replace(c, f"(?U){NOISE}", " "), r"\s+", " "), " -–—,.")
    return out, out != c


def segments(c: Column) -> Column:
    """Parts from small to large: of a breadcrumb, reversed, or between commas; without empty ones."""
    parts = lambda sep: F.filter(F.transform(F.split(c, sep), lambda x: _strip(x)), lambda x: x != "")
    return F.when(c.contains(" > "), F.reverse(parts(" > "))).otherwise(parts(","))


def strip_zip(c: Column) -> Column:
    bare = F.regexp_replace(c, ZIP, "")
    return F.when(bare != "", bare).otherwise(c)


def prefix_country(attempts: DataFrame, look: dict[str, DataFrame]) -> DataFrame:
    """Adds scope, the country of a two-letter prefix if it is one's code, and rest, the text without it."""
    out = attempts.withColumn("__code", F.regexp_extract("place", PREFIX, 1))
    out = looked_up(out.withColumn("__code", F.nullif("__code", F.lit(""))), look["prefix"].select(F.col("code").alias("__code"), F.col("country").alias("scope")), ["__code"])
    rest = F.when(F.col("scope").isNotNull(), F.trim(F.regexp_extract("place", PREFIX, 2))).otherwise(F.col("place"))
    return out.withColumn("rest", rest).drop("__code")


def country_first_dash(attempts: DataFrame, look: dict[str, DataFrame]) -> DataFrame:
    """Adds dashed: the parts between dashes from the first that is a country's name (over two letters) on, reversed."""
    parts = F.filter(F.transform(F.split("rest", " - "), lambda x: _strip(x)), lambda x: x != "")
    out = attempts.withColumn("__parts", F.when(F.col("rest").contains(" - "), parts))
    each = out.where("__parts is not null").select("aid", F.posexplode("__parts").alias("pos", "alias")).where(F.length("alias") > 2)
    first = each.join(look["country"], "alias", "left_semi").groupBy("aid").agg(F.min("pos").alias("__pos"))
    out = out.join(first, "aid", "left")
    tail = F.reverse(F.slice("__parts", F.col("__pos") + 1, F.size("__parts")))
    return out.withColumn("dashed", F.when(F.col("__pos").isNotNull(), tail)).drop("__parts", "__pos")


def _place(city, region, country, resolved=True) -> Column:
    null = F.lit(None).cast("string")
    return F.struct((null if city is None else city).alias("city"), (null if region is None else region).alias("region"), (null if country is None else country).alias("country"), F.lit(resolved).alias("resolved"))


def looked_up(attempts: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """`attempts` left-joined with `table` by `keys`. Most attempts lack some key; these are dealt by their aid, so that no task gets them all."""
    salt = F.concat(F.lit("\0"), F.pmod(F.xxhash64("aid"), F.lit(NULL_SALTS)).cast("string"))
    first = f"__on_{keys[0]}"
    table = table.withColumnRenamed(keys[0], first)
    return attempts.withColumn(first, F.coalesce(keys[0], salt)).join(table, [first, *keys[1:]], "left").drop(first)


def resolve_bare(attempts: DataFrame, look: dict[str, DataFrame]) -> DataFrame:
    """Adds bare, the place of a single part: country, region's name, abbreviation (only after noise went), or city, in this order."""
    token = F.col("token")
    out = looked_up(attempts, look["ambiguous"].select(F.col("token"), F.lit(True).alias("__amb")), ["token"])
    out = looked_up(out, look["country"].select(F.col("alias").alias("token"), F.col("country").alias("__c")), ["token"])
    out = looked_up(out, look["region_full"].select(F.col("alias").alias("token"), F.col("code").alias("__rf"), F.col("country").alias("__rfc")), ["token"])
    out = looked_up(out, look["region_abbrev"].select(F.col("alias").alias("token"), F.col("code").alias("__ra"), F.col("country").alias("__rac")), ["token"])
    out = looked_up(out, look["city"].select(F.col("alias").alias("token"), F.struct("city", "region", "country").alias("__p")), ["token"])
    out = looked_up(out, look["city_in"].select(F.col("alias").alias("token"), "scope", F.struct("city", "region", "country").alias("__ps")), ["token", "scope"])
    scope, none = F.col("scope"), _place(None, None, None, False)
    fits = lambda c: scope.isNull() | (scope == c)
    city = F.when(scope.isNull(), F.col("__p")).otherwise(F.col("__ps"))
    bare = (
        F.when(token.isNull() | token.isin(DESCRIPTORS) | F.col("__amb").isNotNull(), none)
        .when(F.col("__c").isNotNull(), F.when(fits(F.col("__c")), _place(None, None, F.col("__c"))).otherwise(none))
        .when(F.col("__rf").isNotNull(), F.when(fits(F.col("__rfc")), _place(None, F.col("__rf"), F.col("__rfc"))).otherwise(none))
        .when(F.col("noisy") & F.col("__ra").isNotNull(), _place(None, F.col("__ra"), F.col("__rac")))
        .when(city.isNotNull(), _place(city["city"], city["region"], city["country"]))
        .otherwise(none)
    )
    return out.withColumn("bare", bare).drop("__amb", "__c", "__rf", "__rfc", "__ra", "__rac", "__p", "__ps")


def trailing_code(c: Column) -> Column:
    """[city, code] of a text that ends in two letters, else null."""
    return F.when(c.rlike(TRAILING), F.array(F.regexp_extract(c, TRAILING, 1), F.regexp_extract(c, TRAILING, 2)))


def resolve_segments(attempts: DataFrame, look: dict[str, DataFrame]) -> DataFrame:
    """Adds multi, the place of several parts (`parts`, from small to large): the last decides, or nothing does."""
    n = F.size("parts")
    out = attempts.withColumns(
        {
            "__tail": F.when(n > 1, strip_zip(F.element_at("parts", -1))),
            "__head": F.when(n > 1, F.element_at("parts", 1)),
            "__last": F.when(n > 1, F.try_element_at("parts", F.lit(-2))),
        }
    )
    out = looked_up(out, look["country"].select(F.col("alias").alias("__tail"), F.col("country").alias("__tc")), ["__tail"])
    out = looked_up(out, look["region_any"].select(F.col("alias").alias("__tail"), F.col("code").alias("__tr"), F.col("country").alias("__trc")), ["__tail"])
    out = out.withColumn("__country", F.coalesce("__tc", "__trc"))
    scoped = look["region_scoped"].select(F.col("country").alias("__country"), F.col("alias").alias("__last"), F.col("code").alias("__sr"))
    out = looked_up(out, scoped, ["__country", "__last"])
    out = out.withColumn("__region", F.when(F.col("__tc").isNull(), F.col("__tr")).otherwise(F.col("__sr")))
    out = looked_up(out, look["city_alias"].select(F.col("alias").alias("__head"), F.lit(True).alias("__is")), ["__head"])
    pieces = out.where("__is is null").where(F.col("__head").contains("|")).select("aid", F.posexplode(F.transform(F.split("__head", r"\|"), lambda x: _strip(x))).alias("pos", "alias"))
    named = pieces.join(look["city_alias"], "alias", "left_semi").groupBy("aid").agg(F.min_by("alias", "pos").alias("__piece"))
    out = out.join(named, "aid", "left").withColumn("__city", F.coalesce("__piece", "__head"))
    in_country = look["narrow_country"].select(F.col("alias").alias("__city"), F.col("country").alias("__country"), F.col("city").alias("__in_country"))
    in_region = look["narrow_region"].select(F.col("alias").alias("__city"), F.col("country").alias("__country"), F.col("region").alias("__region"), F.col("city").alias("__in_region"))
    out = looked_up(looked_up(out, in_country, ["__city", "__country"]), in_region, ["__city", "__country", "__region"])
    city = F.when(F.col("__region").isNull(), F.col("__in_country")).otherwise(F.col("__in_region"))
    multi = F.when(F.col("__country").isNotNull(), _place(city, F.col("__region"), F.col("__country"))).otherwise(_place(None, None, None, False))
    return out.withColumn("multi", multi).drop(*[c for c in out.columns if c.startswith("__")])


def resolve_once(attempts: DataFrame, look: dict[str, DataFrame]) -> DataFrame:
    """(aid, text) to (aid, result): one attempt at each text."""
    out = attempts.withColumn("cleaned", clean_place(F.col("text"))).withColumn("place", strip_area(first_place(F.col("cleaned"))))
    out = country_first_dash(checkpointed(prefix_country(out, look)), look)
    text, removed = strip_noise(F.col("__bare"))
    out = out.withColumn("__bare", strip_remote(F.col("rest"))).withColumns({"__text": text, "noisy": removed & F.col("dashed").isNull()}).drop("__bare")
    out = out.withColumn("found", F.coalesce("dashed", segments(F.col("__text"))))
    out = out.withColumn("scope", F.when(F.col("dashed").isNull(), F.col("scope")))
    out = out.withColumn("token", F.when(F.size("found") == 1, F.element_at("found", 1)))
    out = resolve_bare(out.withColumn("nothing", F.col("dashed").isNull() & (F.col("__text") == "")).drop("__text"), look)
    again = F.when(~F.col("bare")["resolved"], trailing_code(F.col("token")))
    out = out.withColumn("parts", F.when(F.size("found") > 1, F.col("found")).otherwise(again))
    out = resolve_segments(out.drop("text", "place", "rest", "dashed"), look)
    unresolved = _place(None, None, None, False)
    result = (
        F.when(F.col("cleaned") == "", unresolved)
        .when(F.col("nothing"), _place(None, None, F.col("scope")))
        .when(F.col("parts").isNotNull(), F.col("multi"))
        .otherwise(F.coalesce("bare", unresolved))
    )
    return out.select("aid", result.alias("result"))


def attempts(distinct: DataFrame) -> DataFrame:
    """(raw) to (raw, kind, pos, text): the whole text, then each piece between |, then the text without a last parenthesis."""
    whole = distinct.select("raw", F.lit(0).alias("kind"), F.lit(0).alias("pos"), F.col("raw").alias("text"))
    pieces = distinct.where(F.col("raw").contains("|")).select("raw", F.lit(1).alias("kind"), F.posexplode(F.split("raw", r"\|")).alias("pos", "text"))
    bare = F.regexp_replace("raw", r"\s*\([^()]*\)\s*$", "")
    without = distinct.where(bare != F.col("raw")).select("raw", F.lit(2).alias("kind"), F.lit(0).alias("pos"), bare.alias("text"))
    return whole.unionByName(pieces.where(F.trim("text") != "")).unionByName(without)


def resolve_distinct(distinct: DataFrame, gaz: dict[str, DataFrame]) -> DataFrame:
    """(raw) to (raw, place), computed once. `gaz` is a gazetteer or its prepared tables. A later attempt never overrides an earlier success; a piece with a place goes before one without."""
    tried = attempts(distinct).withColumn("aid", F.struct("raw", "kind", "pos"))
    done = resolve_once(tried.select("aid", "text"), prepared(gaz))
    r = F.col("result")
    nowhere = r["city"].isNull() & r["region"].isNull() & r["country"].isNull()
    rank = F.when(~r["resolved"], 9).when(F.col("aid.kind") == 0, 0).when(F.col("aid.kind") == 1, F.when(nowhere, 2).otherwise(1)).otherwise(3)
    best = done.select(F.col("aid.raw").alias("raw"), rank.alias("rank"), F.col("aid.kind").alias("kind"), F.col("aid.pos").alias("pos"), "result")
    return checkpointed(best.groupBy("raw").agg(F.min_by("result", F.struct("rank", "kind", "pos")).alias("place")))


def resolve_locations(df: DataFrame, gaz: dict[str, DataFrame], *, col: str = "location", version: str = CURRENT_VERSION) -> DataFrame:
    """`df` with location_city, _region, _country ('' where unknown), location_resolved and location_alias_version.

    Each distinct text is resolved once. Null, blank and unknown texts are unresolved; a text that names no place
    ("Remote") is resolved with no parts.
    """
    distinct = df.select(F.col(col).alias("raw")).where("raw is not null").distinct()
    return _with_places(df, resolve_distinct(distinct, gaz), col, version)


def _with_places(df: DataFrame, places: DataFrame, col: str, version: str) -> DataFrame:
    found = places.withColumnRenamed("raw", "__raw")
    names = ["location_city", "location_region", "location_country", "location_resolved", "location_alias_version"]
    out = df.drop(*names).join(found, F.col(col) == F.col("__raw"), "left")
    part = lambda p: F.coalesce(F.col("place")[p], F.lit(""))
    out = out.withColumns(
        {
            "location_city": part("city"),
            "location_region": part("region"),
            "location_country": part("country"),
            "location_resolved": F.coalesce(F.col("place")["resolved"], F.lit(False)),
            "location_alias_version": F.lit(version),
        }
    )
    return out.drop("__raw", "place")


#: Buckets of remembered places.
MEMO_BUCKETS = 64


def resolve_remembered(df: DataFrame, gaz: dict[str, DataFrame], path: str, *, col: str = "location", version: str = CURRENT_VERSION) -> DataFrame:
    """The same rows as `resolve_locations`, with places remembered below `path`: only texts are resolved that this version of the gazetteer has not met.

    The table there has (raw, place, version) in buckets of texts; a round writes the buckets of its new texts, and no
    version of it where there are none: then nothing is looked up in `gaz`, which is not prepared either. Places of
    other versions are not used and go when their bucket is written. Of two rounds at once the second to write fails.
    """
    spark = df.sparkSession
    here = F.pmod(F.xxhash64("raw"), F.lit(MEMO_BUCKETS)).cast("int")
    texts = checkpointed(df.select(F.col(col).alias("raw")).where("raw is not null").distinct())
    found = state.versions(spark, path)
    known = state.read_snapshot(spark, path).where(F.col("version") == version) if found else None
    unseen = texts if known is None else checkpointed(texts.join(known, "raw", "left_anti"))
    touched = sorted(r[0] for r in unseen.select(here.alias("b")).distinct().collect())
    if touched:
        new = resolve_distinct(unseen, gaz).withColumn("version", F.lit(version))
        if known is not None:
            new = new.unionByName(state.read_snapshot(spark, path, only=touched).where(F.col("version") == version))
        state.write_buckets(new, path, found[-1] + 1 if found else 0, bucket=here, n=MEMO_BUCKETS, touched=touched if found else None)
    elif known is None:
        return _with_places(df, resolve_distinct(texts, gaz), col, version)
    places = state.read_snapshot(spark, path).where(F.col("version") == version).select("raw", "place")
    return _with_places(df, places, col, version)


def normalize_targets(profiles: DataFrame, gaz: dict[str, DataFrame], *, key: str = "user_id", col: str = "target_locations") -> DataFrame:
    """(key, target_locations_normalized): each profile's targets in order, one for each resolved place; unresolved and place-less ones all stay."""
    return with_targets(profiles.select(key, col), gaz, col=col).drop(col)


def with_targets(profiles: DataFrame, gaz: dict[str, DataFrame], *, col: str = "target_locations") -> DataFrame:
    """The profiles with target_locations_normalized. A list of targets is worked out once, however many profiles have it."""
    lists = checkpointed(profiles.select(F.col(col).alias("__list")).where("__list is not null").distinct().withColumn("__id", F.monotonically_increasing_id()))
    each = lists.select("__id", F.posexplode("__list").alias("pos", "raw"))
    found = resolve_distinct(each.select("raw").where("raw is not null").distinct(), gaz)
    place = F.coalesce("place", _place(None, None, None, False))
    each = each.join(found, "raw", "left").withColumn("place", place)
    p = F.col("place")
    real = p["resolved"] & (p["city"].isNotNull() | p["region"].isNotNull() | p["country"].isNotNull())
    same = Window.partitionBy("__id", p["city"], p["region"], p["country"], real).orderBy("pos")
    kept = each.withColumn("__real", real).withColumn("__n", F.row_number().over(same)).where("not __real or __n = 1")
    target = F.struct("pos", "raw", p["city"].alias("city"), p["region"].alias("region"), p["country"].alias("country"), p["resolved"].alias("resolved"))
    grouped = kept.groupBy("__id").agg(F.array_sort(F.collect_list(target)).alias("t"))
    bare = F.transform("t", lambda t: F.struct(t["raw"].alias("raw"), t["city"].alias("city"), t["region"].alias("region"), t["country"].alias("country"), t["resolved"].alias("resolved")))
    empty = F.array().cast("array<struct<raw:string,city:string,region:string,country:string,resolved:boolean>>")
    done = lists.join(grouped, "__id").select("__list", bare.alias("__done"))
    return profiles.join(done, F.col(col) == F.col("__list"), "left").withColumn("target_locations_normalized", F.coalesce("__done", empty)).drop("__list", "__done")


def sweep(df: DataFrame, gaz: dict[str, DataFrame], version: str, *, key: list[str], latest: DataFrame | None = None) -> DataFrame:
    """Rows of another version, resolved again and stamped; `latest`, the table as it is meanwhile, keeps rows that moved on."""
    stale = df.where(~F.col("location_alias_version").eqNullSafe(F.lit(version)))
    fresh = resolve_locations(stale.withColumn("__seen", F.col("location_alias_version")), gaz, version=version)
    base = df if latest is None else latest
    names = ["location_city", "location_region", "location_country", "location_resolved", "location_alias_version"]
    new = fresh.select(*key, "__seen", F.struct(*names).alias("__new"))
    out = base.join(new, key, "left")
    use = F.col("__new").isNotNull() & F.col("location_alias_version").eqNullSafe(F.col("__seen"))
    return out.withColumns({n: F.when(use, F.col("__new")[n]).otherwise(F.col(n)) for n in names}).drop("__seen", "__new")


def sweep_profiles(profiles: DataFrame, gaz: dict[str, DataFrame], version: str, *, key: str = "user_id", latest: DataFrame | None = None) -> DataFrame:
    """The same for profiles: stale ones get their targets normalised again; `latest` keeps those that moved on meanwhile."""
    stale = profiles.where(~F.col("target_locations_alias_version").eqNullSafe(F.lit(version)))
    new = normalize_targets(stale, gaz, key=key).withColumnRenamed("target_locations_normalized", "__new")
    new = new.join(stale.select(key, F.col("target_locations_alias_version").alias("__seen"), F.lit(True).alias("__stale")), key)
    out = (profiles if latest is None else latest).join(new, key, "left")
    use = F.coalesce(F.col("__stale"), F.lit(False)) & F.col("target_locations_alias_version").eqNullSafe(F.col("__seen"))
    return out.withColumns(
        {
            "target_locations_normalized": F.when(use, F.col("__new")).otherwise(F.col("target_locations_normalized")),
            "target_locations_alias_version": F.when(use, F.lit(version)).otherwise(F.col("target_locations_alias_version")),
        }
    ).drop("__new", "__seen", "__stale")


def diff_postings(df: DataFrame, gaz: dict[str, DataFrame], *, key: str = "id") -> DataFrame:
    """What resolving again would change for the worse or otherwise, of rows that were resolved; rows that newly resolve are not reported."""
    old = df.where("location_resolved").select(key, "location", F.struct("location_city", "location_region", "location_country").alias("old"))
    new = resolve_locations(old, gaz).select(key, "location", "old", F.struct("location_city", "location_region", "location_country").alias("new"), "location_resolved")
    kind = F.when(~F.col("location_resolved"), "regressed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return new.withColumn("kind", kind).where("kind is not null").select(key, "location", "kind", "old", "new")


def diff_profiles(profiles: DataFrame, gaz: dict[str, DataFrame], *, key: str = "user_id") -> DataFrame:
    """Profiles that would lose a resolved target place, with the places lost."""
    places = lambda c: F.array_distinct(F.transform(F.filter(c, lambda t: t["resolved"]), lambda t: F.struct(t["city"], t["region"], t["country"])))
    new = normalize_targets(profiles, gaz, key=key).withColumnRenamed("target_locations_normalized", "__new")
    both = profiles.join(new, key).withColumn("lost", F.array_except(places(F.col("target_locations_normalized")), places(F.col("__new"))))
    return both.where(F.size("lost") > 0).select(key, "lost")
