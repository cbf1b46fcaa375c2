"""Building a gazetteer of countries, regions and cities, with the collisions of their names decided by grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_alias, feature_tier, looks_like_airport
from ..session import checkpointed

DEFAULT_MIN_POPULATION = 15000
#: Display names and further aliases of some countries; any other shows its ISO code.
COUNTRY_OVERRIDES = {
    "US": ("US", ["us", "usa", "united states", "united states of america", "u.s.", "u.s.a."]),
    "GB": ("UK", ["uk", "united kingdom", "great britain", "u.k."]),
    "DE": ("Germany", ["germany", "deutschland"]),
    "IN": ("India", ["india"]),
    "CA": ("Canada", ["canada"]),
    "KR": ("South Korea", ["korea", "south korea", "republic of korea"]),
    "NL": ("Netherlands", ["netherlands", "the netherlands", "holland"]),
    "TW": ("Taiwan", ["taiwan"]),
    "HK": ("Hong Kong", ["hong kong"]),
    "AE": ("UAE", ["uae", "u.a.e.", "united arab emirates"]),
    "BR": ("Brazil", ["brazil", "brasil"]),
    "CZ": ("Czech Republic", ["czech republic", "czechia"]),
}
#: Postal codes of US states and DC.
US_STATES = [
    "AL", "AK", "AZ", "AR", "CA", "CO", "CT", "DE", "FL", "GA", "HI", "ID", "IL", "IN", "IA", "KS", "KY",
    "LA", "ME", "MD", "MA", "MI", "MN", "MS", "MO", "MT", "NE", "NV", "NH", "NJ", "NM", "NY", "NC", "ND",
    "OH", "OK", "OR", "PA", "RI", "SC", "SD", "TN", "TX", "UT", "VT", "VA", "WA", "WV", "WI", "WY", "DC",
]
#: Postal codes of the numeric first-level codes of two countries.
REGION_CODES = {
    "CA": {"01": "AB", "02": "BC", "03": "MB", "04": "NB", "05": "NL", "07": "NS", "08": "ON", "09": "PE", "10": "QC", "11": "SK", "12": "YT", "13": "NT", "14": "NU"},
    "AU": {"01": "ACT", "02": "NSW", "03": "NT", "04": "QLD", "05": "SA", "06": "TAS", "07": "VIC", "08": "WA"},
}


def _literal_map(pairs) -> Column:
    return F.create_map(*[x for k, v in pairs for x in (F.lit(k), v if isinstance(v, Column) else F.lit(v))])


def country_display(iso: Column) -> Column:
    return F.coalesce(_literal_map((k, v[0]) for k, v in COUNTRY_OVERRIDES.items())[F.coalesce(iso, F.lit(""))], iso)


def build_countries(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(countries, country_alias) from iso, iso3, name, population, ord; aliases are those of the overrides, the codes and the name."""
    more = _literal_map((k, F.array(*[F.lit(a) for a in v[1]])) for k, v in COUNTRY_OVERRIDES.items())
    own = F.array_compact(F.array(clean_alias(F.col("iso")), clean_alias(F.col("iso3")), clean_alias(F.col("name"))))
    extra = F.coalesce(more[F.coalesce("iso", F.lit(""))], F.array().cast("array<string>"))
    countries = rows.select("ord", "iso", country_display(F.col("iso")).alias("name"), "population", F.array_sort(F.array_union(extra, own)).alias("aliases"))
    return countries, countries.select("ord", "iso", "name", "population", F.explode("aliases").alias("alias"))


def _numeric_code(iso: Column, raw: Column) -> Column:
    codes = _literal_map((f"{c}.{k}", v) for c, codes in REGION_CODES.items() for k, v in codes.items())
    return codes[F.concat_ws(".", iso, raw)]


def canonical_region_code(regions: DataFrame, isos: DataFrame, *, iso: str = "iso", raw: str = "raw") -> DataFrame:
    """`regions` with code and abbrev: an alphabetic code as it is; a numeric one by its postal code unless a country has that ISO code.

    isos: one column, iso, of all countries.
    """
    known = isos.select(F.lower("iso").alias("__known")).where("__known is not null and __known <> ''").distinct()
    named = regions.withColumn("__postal", _numeric_code(F.col(iso), F.col(raw)))
    named = named.join(known, F.lower("__postal") == F.col("__known"), "left")
    alpha, free = F.col(raw).rlike(r"^\p{L}+$"), F.col("__postal").isNotNull() & F.col("__known").isNull()
    return named.select(
        *[c for c in regions.columns],
        F.when(alpha, F.col(raw)).when(free, F.col("__postal")).otherwise(F.col(raw)).alias("code"),
        F.when(alpha, clean_alias(F.col(raw))).when(free, clean_alias(F.col("__postal"))).alias("abbrev"),
    )


def build_regions(admin1: DataFrame, isos: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(regions, full_alias, abbrev_alias) from code ("ISO.code"), name, ord."""
    split = admin1.where(F.col("code").contains(".")).select(
        "ord",
        "name",
        F.substring_index("code", ".", 1).alias("iso"),
        F.expr("substring(code, instr(code, '.') + 1)").alias("raw"),
        clean_alias(F.col("name")).alias("full"),
    )
    regions = canonical_region_code(split, isos).withColumn("country", country_display(F.col("iso")))
    full = regions.where("full is not null").select("full", "iso", "raw").withColumnRenamed("full", "alias")
    abbrev = regions.where("abbrev is not null").select("abbrev", "iso", "raw").withColumnRenamed("abbrev", "alias")
    return regions, full, abbrev


def build_cities(cities: DataFrame, admin1: DataFrame, country_alias: DataFrame, isos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cities, city_alias) from CITY_ROW's columns and ord.

    The region is set only if its first-level code is known. Names are aliases; alternate names too, unless they
    look like airport codes or are a country's alias.
    """
    known = admin1.select("code").distinct().withColumnRenamed("code", "__code")
    keyed = cities.withColumn("__key", F.when(F.col("admin1_code") != "", F.concat_ws(".", "country_code", "admin1_code")))
    coded = canonical_region_code(keyed, isos, iso="country_code", raw="admin1_code")
    coded = coded.join(known, F.col("__key") == F.col("__code"), "left")
    base = coded.select(
        "ord",
        "name",
        F.when(F.col("__code").isNotNull(), F.col("code")).alias("region"),
        country_display(F.col("country_code")).alias("country"),
        "population",
        "feature_code",
        "asciiname",
        "alternatenames",
    )
    primary = base.select("ord", F.explode(F.array(clean_alias(F.col("name")), clean_alias(F.col("asciiname")))).alias("alias")).where("alias is not null")
    raw = base.select("ord", F.explode(F.split(F.coalesce("alternatenames", F.lit("")), ",")).alias("raw")).withColumn("raw", F.trim("raw"))
    other = raw.where(~looks_like_airport(F.col("raw"))).select("ord", clean_alias(F.col("raw")).alias("alias")).where("alias is not null")
    other = other.join(country_alias.select("alias").distinct(), "alias", "left_anti").select("ord", "alias")
    alias = primary.unionByName(other).distinct()
    grouped = alias.groupBy("ord").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    table = base.join(grouped, "ord", "left").select("ord", "name", "region", "country", "population", "feature_code", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
    return table, alias


def cross_type_collisions(country_alias: DataFrame, full_alias: DataFrame, city_alias: DataFrame) -> DataFrame:
    """(alias, decision) of aliases that more than one of country, region and city claims.

    region and city: `demoted`, the city wins; country and city: none, the country wins by order; country and
    region, all of the region's owners among the alias's countries: `demoted`; anything else: `ambiguous`.
    """
    none = F.lit(None).cast("string")
    claims = country_alias.select("alias", F.lit("c").alias("kind"), "iso")
    claims = claims.unionByName(full_alias.select("alias", F.lit("r").alias("kind"), "iso")).unionByName(city_alias.select("alias", F.lit("p").alias("kind"), none.alias("iso")))
    has = lambda k: F.bool_or(F.col("kind") == k)
    isos = lambda k: F.collect_set(F.when(F.col("kind") == k, F.col("iso")))
    both = claims.groupBy("alias").agg(has("c").alias("c"), has("r").alias("r"), has("p").alias("p"), isos("c").alias("cs"), isos("r").alias("rs"))
    owned = F.size(F.array_except("rs", "cs")) == 0
    c, r, p = F.col("c"), F.col("r"), F.col("p")
    decision = F.when(r & p & ~c, "demoted").when(c & p & ~r, None).when(c & r & ~p & owned, "demoted").when(c & r, "ambiguous")
    return both.select("alias", decision.alias("decision")).where("decision is not null")


def same_type_collisions(country_alias: DataFrame, full_alias: DataFrame) -> DataFrame:
    """Aliases of more than one country, or of more than one region; cities are exempt."""
    countries = country_alias.groupBy("alias").agg(F.count_distinct("iso").alias("n"))
    regions = full_alias.groupBy("alias").agg(F.count_distinct("iso", "raw").alias("n"))
    return countries.unionByName(regions).where("n > 1").select("alias").distinct()


def abbrev_collisions(country_alias: DataFrame, abbrev_alias: DataFrame) -> DataFrame:
    """Country aliases that are a region's abbreviation too."""
    return country_alias.select("alias").intersect(abbrev_alias.select("alias"))


def iso2_prefixes(country_alias: DataFrame) -> DataFrame:
    """(code, country) of two-letter country aliases that are no US state's; later rows win."""
    two = country_alias.where(F.length("alias") == 2).where(~F.upper("alias").isin(US_STATES))
    return two.groupBy(F.col("alias").alias("code")).agg(F.max_by("name", "ord").alias("country"))


def build_gazetteer(cities: DataFrame, admin1: DataFrame, countries: DataFrame, *, min_population: int = DEFAULT_MIN_POPULATION, version: str = "v1") -> dict[str, DataFrame]:
    """countries, regions, cities, ambiguous and prefixes of one version; inputs as the readers give them, with ord."""
    isos = countries.select("iso")
    table, country_alias = build_countries(countries)
    regions, full_alias, abbrev_alias = build_regions(admin1, isos)
    places, city_alias = build_cities(cities.where(F.col("population") >= min_population), admin1, country_alias, isos)
    cross = cross_type_collisions(country_alias, full_alias, city_alias)
    ambiguous = cross.where("decision = 'ambiguous'").select("alias").union(same_type_collisions(country_alias, full_alias)).distinct()
    demoted = cross.where("decision = 'demoted'").select("alias")
    dropped = ambiguous.union(abbrev_collisions(country_alias, abbrev_alias)).distinct()
    kept = country_alias.join(dropped, "alias", "left_anti").groupBy("ord").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    stamp = F.lit(version).alias("version")
    marks = ambiguous.withColumn("mark", F.lit("ambiguous")).unionByName(demoted.withColumn("mark", F.lit("demoted"))).groupBy("alias").agg(F.min("mark").alias("mark"))
    marked = regions.join(marks.withColumnRenamed("alias", "full"), "full", "left")
    one = lambda on, c: F.when(on & F.col(c).isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))
    return {
        "countries": table.drop("aliases").join(kept, "ord").select("ord", "name", "aliases", "population", stamp),
        "regions": marked.select(
            "ord",
            "name",
            "code",
            "country",
            one(F.col("mark").isNull(), "full").alias("full_aliases"),
            one(F.coalesce(F.col("mark") == "demoted", F.lit(False)), "full").alias("comma_context_full_aliases"),
            one(F.lit(True), "abbrev").alias("abbrev_aliases"),
            stamp,
        ),
        "cities": places.select("*", stamp),
        "ambiguous": ambiguous.select(F.col("alias").alias("token"), stamp),
        "prefixes": iso2_prefixes(country_alias).select("code", "country", stamp),
    }


_ROW = ("kind", "ord", "alias", "name", "code", "country", "population", "feature_code")
_LOOKUP = ("alias", "token", "scope", "city", "region", "code", "country")


def _laid_out(df: DataFrame, columns: tuple[str, ...], kind: str) -> DataFrame:
    """`df` with these columns as strings or longs, null where it has none."""
    long = {"ord", "population"}
    have = lambda c: F.lit(kind) if c == "kind" else F.col(c) if c in df.columns else F.lit(None)
    return df.select(*[have(c).cast("long" if c in long else "string").alias(c) for c in columns])


def alias_rows(gaz: dict[str, DataFrame]) -> DataFrame:
    """All aliases of a gazetteer in one table, by kind; the kind `population` has each country's."""
    regions = [gaz["regions"].select("ord", "code", "country", F.explode(f"{k}_aliases").alias("alias")) for k in ("full", "comma_context_full", "abbrev")]
    parts = {
        "country": gaz["countries"].select("ord", "name", "population", F.explode("aliases").alias("alias")),
        "population": gaz["countries"].select("ord", "name", "population"),
        **dict(zip(("full", "comma", "abbrev"), regions, strict=True)),
        "city": gaz["cities"].select("ord", "name", F.col("region").alias("code"), "country", "population", "feature_code", F.explode("aliases").alias("alias")),
        "ambiguous": gaz["ambiguous"].select(F.col("token").alias("alias")),
        "prefix": gaz["prefixes"].select(F.col("code").alias("alias"), "country"),
    }
    out = None
    for kind, df in parts.items():
        laid = _laid_out(df, _ROW, kind)
        out = laid if out is None else out.unionByName(laid)
    return out


def lookup_tables(rows: DataFrame) -> dict[str, DataFrame]:
    """What resolving a place looks up, of `alias_rows`, each keyed so that it has one row a key.

    country(alias, country), region_full(alias, code, country) and region_scoped(country, alias, code): later rows
    win. region_any and region_abbrev(alias, code, country): the most populous country's, ties by order. city and
    city_in: the best city of an alias, and of an alias in a country, by population, then tier, then order. narrow:
    the city of (alias, country) and of (alias, country, region) if there is exactly one. city_alias: all city aliases.
    """
    of = lambda *kinds: rows.where(F.col("kind").isin(*kinds))
    population = of("population").groupBy("name").agg(F.max_by("population", "ord").alias("p"))
    rank = F.when(F.col("kind") == "full", 0).when(F.col("kind") == "comma", 1).otherwise(2)
    region = of("full", "comma", "abbrev").select("ord", "kind", rank.alias("rank"), "code", "country", "alias")
    ranked = region.join(population, region["country"] == population["name"], "left").withColumn("p", F.coalesce("p", F.lit(0)))
    most = lambda df: df.groupBy("alias").agg(F.min_by(F.struct("code", "country"), F.struct(-F.col("p"), "ord", "rank")).alias("r")).select("alias", "r.*")
    city = of("city").withColumnRenamed("code", "region")
    place = F.struct(F.col("name").alias("city"), "region", "country")
    first = F.struct(-F.coalesce("population", F.lit(0)), feature_tier(F.col("feature_code")), "ord")
    best = F.min_by(place, first).alias("c")
    only = lambda keys: city.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("c")).where("n = 1").select(*keys, F.col("c.city").alias("city"))
    return {
        "country": of("country").groupBy("alias").agg(F.max_by("name", "ord").alias("country")),
        "region_full": of("full").groupBy("alias").agg(F.max_by(F.struct("code", "country"), "ord").alias("r")).select("alias", "r.*"),
        "region_any": most(ranked),
        "region_abbrev": most(ranked.where("kind = 'abbrev'")),
        "region_scoped": region.groupBy("country", "alias").agg(F.max_by("code", F.struct("ord", "rank")).alias("code")),
        "city": city.groupBy("alias").agg(best).select("alias", "c.*"),
        "city_in": city.groupBy("alias", F.col("country").alias("scope")).agg(best).select("alias", "scope", "c.*"),
        "city_alias": city.select("alias").distinct(),
        "narrow_country": only(["alias", "country"]),
        "narrow_region": only(["alias", "country", "region"]),
        "ambiguous": of("ambiguous").select(F.col("alias").alias("token")).distinct(),
        "prefix": of("prefix").select(F.col("alias").alias("code"), "country"),
    }


def prepared(gaz: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The lookup tables of a gazetteer, computed once, in two jobs; pass them on to all that resolves places."""
    if "city_alias" in gaz:
        return gaz
    tables = lookup_tables(checkpointed(alias_rows(gaz)))
    out = None
    for name, df in tables.items():
        laid = _laid_out(df, _LOOKUP, name).withColumn("of", F.lit(name))
        out = laid if out is None else out.unionByName(laid)
    out = checkpointed(out)
    return {name: out.where(F.col("of") == name).select(*df.columns) for name, df in tables.items()}
