"""Gazetteer build and place resolution on a small gazetteer of our own."""

import pytest
from pyspark.sql import functions as F

from vacantry.operators import gazetteer, location
from vacantry.schemas import PLACE
from vacantry.sources import files

US, CA = "US", "CA"
COUNTRIES = [("US", "USA", "United States", 331), ("GB", "GBR", "United Kingdom", 67), ("NZ", "NZL", "New Zealand", 5), ("MX", "MEX", "Mexico", 128), ("SG", "SGP", "Singapore", 6), ("CN", "CHN", "China", 1400), ("AU", "AUS", "Australia", 26),
             ("AQ", "ATA", "Antarctica", 0), ("IT", "ITA", "Italy", 60), ("GA", "GAB", "Gabon", 2), ("GE", "GEO", "Georgia", 4), ("IN", "IND", "India", 1400), ("CA", "CAN", "Canada", 38), ("DE", "DEU", "Germany", 83), ("TH", "THA", "Thailand", 70), ("LU", "LUX", "Luxembourg", 1)]
ADMIN1 = [("US.GA", "Georgia"), ("US.CA", "California"), ("US.NY", "New York"), ("US.AZ", "Arizona"), ("US.TX", "Texas"), ("US.WA", "Washington"), ("US.MI", "Michigan"), ("US.IL", "Illinois"), ("US.DC", "Washington, D.C."), ("US.MA", "Massachusetts"),
          ("US.MO", "Missouri"), ("US.FL", "Florida"), ("CA.08", "Ontario"), ("CA.05", "Newfoundland"), ("LU.CA", "Capellen"), ("AU.02", "New South Wales"), ("GB.ENG", "England"), ("IN.19", "Karnataka")]
CITIES = [("Atlanta", "Atlanta", "ATL", "PPLA", "US", "GA", 498715), ("New York City", "New York City", "New York,NYC", "PPL", "US", "NY", 8175133), ("Albany", "Albany", "", "PPLA", "US", "NY", 97856), ("Phoenix", "Phoenix", "", "PPLA", "US", "AZ", 1445632),
          ("Chicago", "Chicago", "", "PPLA2", "US", "IL", 2695598), ("Austin", "Austin", "", "PPLA", "US", "TX", 790390), ("Seattle", "Seattle", "", "PPLA2", "US", "WA", 608660), ("San Francisco", "San Francisco", "SF,SFO", "PPLA2", "US", "CA", 805235),
          ("San Jose", "San Jose", "", "PPLA2", "US", "CA", 945942), ("Washington", "Washington", "", "PPLC", "US", "DC", 601723), ("Springfield", "Springfield", "", "PPL", "US", "IL", 114394), ("Springfield", "Springfield", "", "PPL", "US", "MA", 155929),
          ("Springfield", "Springfield", "", "PPL", "US", "FL", 23363), ("Munich", "Munich", "München,Muenchen", "PPLA", "DE", "", 1260391), ("Berlin", "Berlin", "", "PPLC", "DE", "", 3426354), ("London", "London", "LON,Londres", "PPLC", "GB", "ENG", 8961989),
          ("Cambridge", "Cambridge", "", "PPL", "GB", "ENG", 145700), ("Bengaluru", "Bengaluru", "Bangalore", "PPLA", "IN", "19", 8443675), ("Rome", "Rome", "Roma", "PPLC", "IT", "", 2318895), ("Shanghai", "Shanghai", "", "PPLA", "CN", "", 22315474),
          ("Sydney", "Sydney", "", "PPLA", "AU", "02", 4627345), ("Singapore", "Singapore", "", "PPLC", "SG", "", 3547809), ("Bangkok", "Bangkok", "", "PPLC", "TH", "", 5104476), ("Toronto", "Toronto", "India,YYZ", "PPLA", "CA", "08", 2600000),
          ("Delta", "Delta", "", "PPL", "CA", "02", 101668), ("Tiny", "Tiny", "", "PPL", "CA", "08", 900)]


def inputs(spark, countries=COUNTRIES, admin1=ADMIN1, cities=CITIES):
    make = lambda rows, schema: spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord long, " + schema)
    return (
        make(cities, "name string, asciiname string, alternatenames string, feature_code string, country_code string, admin1_code string, population long"),
        make(admin1, "code string, name string"),
        make(countries, "iso string, iso3 string, name string, population long"),
    )


@pytest.fixture(scope="module")
def look(spark):
    return gazetteer.prepared(gazetteer.build_gazetteer(*inputs(spark)))


N, U = (None, None, None, True), (None, None, None, False)
CASES = {
    "Remote": N, "Hybrid": N, "World Wide - Remote": N, "Remoto": N, "Location TBD": N, "2 Locations": N, "In-Office": N, "Any CEO Office": N, "Multiple Cities": N, "Remote | Hybrid": N,
    "Remote - US": (None, None, "US", True), "US - Remote": (None, None, "US", True), "GA": U, "Georgia": U, "GA - Atlanta": U, "Nowhere": U, "": U, "   ": U, None: U,
    "Atlanta, GA": ("Atlanta", "GA", "US", True), "Atlanta GA": ("Atlanta", "GA", "US", True), "GA | Atlanta, GA": ("Atlanta", "GA", "US", True), "California": (None, "CA", "US", True),
    "New York, NY or Remote": ("New York City", "NY", "US", True), "  new york,  ny.  ": ("New York City", "NY", "US", True), "München": ("Munich", None, "Germany", True), "Munich": ("Munich", None, "Germany", True),
    "Austin, Georgia": U, "Chicago, Timbuktu": U, "Somewhere, 10065": U, "Seattle, Antarctica": (None, None, "AQ", True), "Bangalore Area": ("Bengaluru", "19", "India", True), "Rome Metropolitain Area": ("Rome", None, "IT", True),
    "Bay Area": U, "Metro Area": U, "Metro": U, "Downtown": U, "Delta": U, "NZ - Cambridge": U, "MX - Berlin": U, "NZ - Germany": U, "NZ - Texas": U, "SG - Singapore": (None, None, "SG", True), "UK - London": ("London", "ENG", "UK", True),
    "US > Arizona > Phoenix": ("Phoenix", "AZ", "US", True), "China > Shanghai": ("Shanghai", None, "CN", True), "San Jose | San Francisco": ("San Jose", "CA", "US", True), "Remote-Friendly (Travel Required) | San Francisco, CA": ("San Francisco", "CA", "US", True),
    "APAC - Australia - Sydney": ("Sydney", None, "AU", True), "Retail - New York": U, "Bangkok (Central World Office)": ("Bangkok", None, "TH", True), "Toronto, ON (Canada)": ("Toronto", "ON", "Canada", True), "Washington, D.C.": ("Washington", "DC", "US", True),
    "U.S. - Chicago": ("Chicago", "IL", "US", True), "510 East 62nd Street, New York, NY 10065": (None, "NY", "US", True), "Hybrid - MI": (None, "MI", "US", True), "Remotely based": U, "Emeryville HQ": U, "springfield": ("Springfield", "MA", "US", True),
    "Remote | San Francisco HQ": ("San Francisco", "CA", "US", True), "New York Office": ("New York City", "NY", "US", True), "N/A": U,
}


def test_places(spark, look):
    df = spark.createDataFrame([(k,) for k in CASES], "location string")
    got = {r["location"]: r for r in location.resolve_locations(df, look).collect()}
    wrong = {}
    for text, want in CASES.items():
        r = got[text]
        have = (r["location_city"], r["location_region"], r["location_country"], r["location_resolved"])
        if have != tuple("" if x is None else x for x in want):
            wrong[text] = (have, want)
    assert not wrong
    assert all(r["location_alias_version"] == "v3" for r in got.values())


def test_empty_gazetteer_resolves_no_place(spark):
    none = gazetteer.prepared(gazetteer.build_gazetteer(*[df.limit(0) for df in inputs(spark)]))
    df = spark.createDataFrame([("Atlanta, GA",), ("Remote",)], "location string")
    assert {r["location"]: r["location_resolved"] for r in location.resolve_locations(df, none).collect()} == {"Atlanta, GA": False, "Remote": True}


def test_targets(spark, look):
    rows = [(1, ["SF", "San Francisco"]), (2, ["Remote", "Anywhere", "US"]), (3, ["Chicago", "chicago", "Nowhere", "Nowhere"]), (4, []), (5, None)]
    got = location.normalize_targets(spark.createDataFrame(rows, "user_id long, target_locations array<string>"), look)
    said = {r["user_id"]: [t["raw"] for t in r["target_locations_normalized"]] for r in got.collect()}
    assert said == {1: ["SF"], 2: ["Remote", "Anywhere", "US"], 3: ["Chicago", "Nowhere", "Nowhere"], 4: [], 5: []}


def decisions(spark, countries, admin1, cities):
    return gazetteer.build_gazetteer(*inputs(spark, countries, admin1, cities))


def aliases(table, column="aliases"):
    return {r["name"]: set(r[column]) for r in table.collect()}


def test_collisions(spark):
    gb, us = ("GB", "GBR", "United Kingdom", 67), ("US", "USA", "United States", 331)
    g = decisions(spark, [gb, us], [("US.UK", "Somewhere")], [])
    assert "uk" not in aliases(g["countries"])["UK"]  # a region's abbreviation
    assert {r["code"]: r["country"] for r in g["prefixes"].collect()}["uk"] == "UK"  # taken before
    g = decisions(spark, [gb, us], [("GB.99", "UK")], [])
    assert "uk" in aliases(g["countries"])["UK"] and aliases(g["regions"], "full_aliases") == {"UK": set()}
    g = decisions(spark, [gb, us], [("US.A", "Central"), ("GB.B", "Central")], [])
    assert [r["token"] for r in g["ambiguous"].collect()] == ["central"]
    town = lambda name, country="US": (name, name, "LON,Foo", "PPL", country, "A", 20000)
    g = decisions(spark, [gb, us], [("US.A", "Alpha")], [town("Alpha")])
    assert aliases(g["regions"], "full_aliases") == {"Alpha": set()} and aliases(g["regions"], "comma_context_full_aliases") == {"Alpha": {"alpha"}}
    assert aliases(g["cities"]) == {"Alpha": {"alpha", "foo"}}  # no airport code
    g = decisions(spark, [("SG", "SGP", "Singapore", 6)], [], [town("Singapore", "SG")])
    assert "singapore" in aliases(g["countries"])["SG"]
    g = decisions(spark, [gb, us], [], [("Small", "Small", "", "PPL", "US", "", 100)])
    assert g["cities"].count() == 0


def test_postal_codes(spark):
    regions = gazetteer.build_regions(spark.createDataFrame([(0, "CA.08", "Ontario"), (1, "CA.05", "Newfoundland"), (2, "AU.05", "South Australia"), (3, "XX.7", "Other")], "ord long, code string, name string"), spark.createDataFrame([("NL",), ("SA",), ("CA",)], "iso string"))[0]
    assert {r["name"]: (r["code"], r["abbrev"]) for r in regions.collect()} == {"Ontario": ("ON", "on"), "Newfoundland": ("05", None), "South Australia": ("05", None), "Other": ("7", None)}


def test_sweep_is_idempotent_and_guarded(spark, look):
    names = "posting_id long, location string, location_city string, location_region string, location_country string, location_resolved boolean, location_alias_version string"
    df = spark.createDataFrame([(1, "Atlanta, GA", "", "", "", False, "v1"), (2, "Remote", "", "", "", True, "v3"), (3, "Chicago", "Old", "", "", True, "v1")], names)
    once = location.sweep(df, look, "v3", key=["posting_id"])
    assert {r["posting_id"]: r["location_city"] for r in once.collect()} == {1: "Atlanta", 2: "", 3: "Chicago"}
    assert sorted(map(tuple, location.sweep(once, look, "v3", key=["posting_id"]).collect())) == sorted(map(tuple, once.collect()))
    moved = df.withColumn("location_alias_version", F.when(F.col("posting_id") == 3, "v4").otherwise(F.col("location_alias_version")))
    guarded = {r["posting_id"]: (r["location_city"], r["location_alias_version"]) for r in location.sweep(df, look, "v3", key=["posting_id"], latest=moved).collect()}
    assert guarded[3] == ("Old", "v4") and guarded[1] == ("Atlanta", "v3")
    diff = {r["id"]: r["kind"] for r in location.diff_postings(spark.createDataFrame([(1, "Atlanta, GA", "Atlanta", "GA", "US", True), (2, "Nowhere", "X", "", "", True), (3, "Chicago", "Y", "", "", True), (4, "Chicago", "", "", "", False)], "id long, location string, location_city string, location_region string, location_country string, location_resolved boolean"), look).collect()}
    assert diff == {2: "regressed", 3: "changed"}


def test_sweep_of_profiles(spark, look):
    kind = "array<struct<raw:string,city:string,region:string,country:string,resolved:boolean>>"
    rows = [(1, ["Chicago"], [], "v1"), (2, ["Chicago"], [], "v3"), (3, [], None, None)]
    df = spark.createDataFrame(rows, f"user_id long, target_locations array<string>, target_locations_normalized {kind}, target_locations_alias_version string")
    got = {r["user_id"]: ([t["city"] for t in r["target_locations_normalized"]], r["target_locations_alias_version"]) for r in location.sweep_profiles(df, look, "v3").collect()}
    assert got == {1: (["Chicago"], "v3"), 2: ([], "v3"), 3: ([], "v3")}


def test_reference_files(spark, tmp_path):
    row = lambda name, pop, code="PPL": "\t".join(["1", name, name, f"{name}ville", "0", "0", "P", code, "US", "", "GA", "", "", "", pop, "", "5", "America/New_York", "2020-01-01"])
    (tmp_path / "cities.txt").write_text("\n".join([row("A", "15000"), row("B", "14999"), row("C", "bad"), row("Ü", "20000"), "short\trow"]) + "\n")
    got = files.read_cities(spark, str(tmp_path / "cities.txt"))
    assert [(r["name"], r["population"]) for r in got.orderBy("ord").collect()] == [("A", 15000), ("Ü", 20000)]
    assert files.read_cities(spark, str(tmp_path / "cities.txt"), 0).where("name = 'C'").first()["population"] == 0
    (tmp_path / "admin1.txt").write_text("US.GA\tOld\tOld\t1\nUS.GA\tGeorgia\tGeorgia\t1\nalone\n")
    assert [(r["code"], r["name"]) for r in files.read_admin1(spark, str(tmp_path / "admin1.txt")).collect()] == [("US.GA", "Georgia")]
    (tmp_path / "countries.txt").write_text("# comment\tx\nUS\tUSA\t840\tUS\tUnited States\tWashington\t1\t331\tNA\n\tx\t\t\tNone\t\t\t5\t\nFR\tFRA\t250\tFR\tFrance\tParis\t1\tmany\tEU\n")
    assert sorted((r["iso"], r["population"]) for r in files.read_countries(spark, str(tmp_path / "countries.txt")).collect()) == [("FR", 0), ("US", 331)]


def test_lines_are_numbered_over_files_and_splits(spark, tmp_path):
    """The order of file names, then of lines, whatever the sizes of files and the packing of their splits; the last line of a code wins."""
    sizes = {"a.txt": 40, "b.txt": 3000, "c.txt": 0, "d.txt": 700, "e.txt": 1}
    lines = [(f"US.{k % 90:02}", f"name {name} {k}") for name, n in sizes.items() for k in range(n)]
    at = iter(lines)
    for name, n in sizes.items():
        (tmp_path / name).write_text("".join(f"{code}\t{said}\t{said}\t1\n" for code, said in (next(at) for _ in range(n))))
    known = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = files._tsv(spark, str(tmp_path), ["code", "name", "ascii", "id"])
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        assert [(r["code"], r["name"]) for r in df.orderBy("ord").collect()] == lines and {r["ord"] for r in df.collect()} == set(range(len(lines)))
        last, first = dict(lines), {}
        for k, (code, _) in enumerate(lines):
            first.setdefault(code, k)
        assert {r["code"]: (r["name"], r["ord"]) for r in files.read_admin1(spark, str(tmp_path)).collect()} == {code: (last[code], first[code]) for code in last}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", known)


def test_null_keys_are_spread(spark):
    """Attempts without a key come through a lookup unmatched, dealt over the tasks."""
    known = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(2000).select(F.col("id").alias("aid"), F.when(F.col("id") % 100 == 0, "paris").alias("token"))
        out = location.looked_up(df, spark.createDataFrame([("paris", "FR"), (None, "XX")], "token string, country string"), ["token"])
        sizes = [r["count"] for r in out.where("token is null").groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert out.count() == 2000 and out.where("country = 'FR'").count() == 20 and out.where("token is null and country is not null").isEmpty()
        assert len(sizes) == 4 and max(sizes) < 0.4 * sum(sizes)
    finally:
        for k, x in known.items():
            spark.conf.set(k, x)


def test_gazetteer_on_disk(spark, tmp_path):
    g = gazetteer.build_gazetteer(*inputs(spark))
    files.write_gazetteer(g, str(tmp_path), "v9", "names of places")
    again = files.load_gazetteer(spark, str(tmp_path), "v9")
    assert again["cities"].count() == g["cities"].count()
    with pytest.raises(files.GazetteerError):
        files.load_gazetteer(spark, str(tmp_path), "v10")
    assert PLACE.fieldNames() == ["city", "region", "country", "resolved"]


def test_registered_place_shapes(spark):
    """Prefixes, trailing codes, pieces, parentheses, postal codes, dashes and abbreviations over the tables of the driver."""
    from vacantry.plans import queries

    got = queries.l_places(spark, "/root/testdata/sf0.001").collect()
    shapes = {r["place_id"] % 8 for r in got if r["location_resolved"]}
    assert shapes == {0, 2, 3, 4, 5, 6, 7}  # 1 has the prefix of another country
    trailing = [r for r in got if r["place_id"] % 8 == 2 and r["location_resolved"]]
    assert all(r["location"] == f"{r['location_city'] or 'NATION_0'} {r['location_region']}" for r in trailing)
