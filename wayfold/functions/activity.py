"""Activity attributes as column expressions: sports, virtual rides, durations, text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfold.functions.geo import _c

# The sport names of activities.
SPORTS = ["Cycling", "E-biking", "Running", "Walking", "Hiking", "Swimming", "Skiing", "Snowboarding",
          "Cross-country skiing", "Rowing", "Inline skating", "Fitness", "Diving", "Activity"]

# Sport names of upstream activity types.
FEED_SPORTS = {
    "Ride": "Cycling", "MountainBikeRide": "Cycling", "GravelRide": "Cycling", "VirtualRide": "Cycling",
    "Handcycle": "Cycling", "Velomobile": "Cycling",
    "EBikeRide": "E-biking", "EMountainBikeRide": "E-biking",
    "Run": "Running", "TrailRun": "Running", "VirtualRun": "Running",
    "Walk": "Walking", "Hike": "Hiking", "Swim": "Swimming",
    "AlpineSki": "Skiing", "BackcountrySki": "Skiing", "NordicSki": "Skiing", "Snowboard": "Skiing",
    "Rowing": "Rowing", "VirtualRow": "Rowing", "InlineSkate": "Inline skating",
}

# Sport names of device sport codes.
CODE_SPORTS = {1: "Running", 2: "Cycling", 4: "Fitness", 5: "Swimming", 11: "Walking", 12: "Cross-country skiing",
               13: "Skiing", 14: "Snowboarding", 15: "Rowing", 17: "Hiking", 21: "E-biking", 30: "Inline skating",
               53: "Diving"}

# Words in the names of indoor and virtual activities, device sub-sports and makers.
VIRTUAL_WORDS = ["zwift", "rouvy", "mywhoosh", "bkool", "fulgaz", "trainerroad", "wahoo systm", "kinomap", "virtual",
                 "indoor"]
VIRTUAL_SUB_SPORTS = [1, 6, 14, 58]
VIRTUAL_MANUFACTURERS = [260]

# Files exported by the library itself keep their name.
OWN_EXPORT = r"-Strava-\d+\.fit$"

CYCLING_SPORTS = ["Cycling", "E-biking"]
RUNNING_SPORTS = ["Running"]
WALKING_SPORTS = ["Walking", "Hiking"]


def _lookup(key: Column, table: dict) -> Column:
    pairs = [F.lit(v) for item in table.items() for v in item]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit("Activity"))


def sport_from_feed(kind) -> Column:
    return _lookup(_c(kind), FEED_SPORTS)


def sport_from_code(code) -> Column:
    return _lookup(_c(code).cast("int"), CODE_SPORTS)


def name_is_virtual(name) -> Column:
    return F.lower(_c(name)).rlike("|".join(VIRTUAL_WORDS))


def is_zwift_name(name) -> Column:
    return F.lower(_c(name)).startswith("zwift")


def is_virtual(name=None, kind=None, trainer=None, sub_sport=None, manufacturer=None) -> Column:
    """Whether any of the given attributes marks an indoor or virtual activity; nulls never do."""
    checks = []
    if name is not None:
        checks.append(name_is_virtual(name))
    if kind is not None:
        checks.append(_c(kind).startswith("Virtual"))
    if trainer is not None:
        checks.append(_c(trainer))
    if sub_sport is not None:
        checks.append(_c(sub_sport).isin(VIRTUAL_SUB_SPORTS))
    if manufacturer is not None:
        checks.append(_c(manufacturer).isin(VIRTUAL_MANUFACTURERS))
    result = F.lit(False)
    for check in checks:
        result = result | F.coalesce(check, F.lit(False))
    return result


def is_on_map(virtual="is_virtual", n_points="n_points") -> Column:
    return ~F.coalesce(_c(virtual), F.lit(False)) & (F.coalesce(_c(n_points), F.lit(0)) > 0)


def duration(moving="moving_s", elapsed="elapsed_s") -> Column:
    return F.when(_c(moving) > 0, _c(moving)).otherwise(_c(elapsed))


def avg_speed(moving="moving_s", elapsed="elapsed_s", distance="distance_m") -> Column:
    seconds = duration(moving, elapsed)
    return F.when((seconds > 0) & (_c(distance) > 0), _c(distance) / seconds)


def quality(n_points="n_points", is_summary="is_summary") -> Column:
    return (F.when(F.coalesce(_c(n_points), F.lit(0)) == 0, F.lit(0))
            .when(_c(is_summary), F.lit(1)).otherwise(F.lit(2)))


def details_text(moving="moving_s", elapsed="elapsed_s", distance="distance_m", power="avg_power_w") -> Column:
    """"1:23:45 · 42.3 km · 215 W", with "28.4 km/h" instead where no power is known."""
    seconds = duration(moving, elapsed)
    whole = F.rint(seconds).cast("bigint")
    clock = F.when(seconds >= 3600, F.format_string("%d:%02d:%02d", F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60)) \
        .otherwise(F.format_string("%d:%02d", F.floor(whole / 60), whole % 60))
    speed = avg_speed(moving, elapsed, distance)

    def tenths(value, digits):
        """Rounded as the decimal it stands for: 22.85 may be stored as 22.849999999999998."""
        return F.round(value.cast(f"decimal(18,{digits})"), 1).cast("double")

    return F.concat_ws(" · ",
                       F.when(seconds > 0, clock),
                       F.when(_c(distance) > 0, F.format_string("%.1f km", tenths(_c(distance) / 1000, 7))),
                       F.when(_c(power) > 0, F.format_string("%.0f W", _c(power)))
                       .when(speed.isNotNull(), F.format_string("%.1f km/h", tenths(speed * 3.6, 9))))


def category(sport="sport") -> Column:
    return (F.when(_c(sport).isin("Cycling", "E-biking"), "bike").when(_c(sport) == "Running", "run")
            .when(_c(sport).isin("Walking", "Hiking"), "foot").otherwise("other"))


def folded_contains(text, needle: str) -> Column:
    """Contains, ignoring case and accents."""
    return F.contains(F.collate(_c(text), "UNICODE_CI_AI"), F.collate(F.lit(needle), "UNICODE_CI_AI"))


def _folds() -> dict[str, str]:
    """Accented Latin letters and the plain letters they are written with."""
    import unicodedata
    letters = (chr(c) for block in (range(0xC0, 0x250), range(0x1E00, 0x1F00)) for c in block)
    plain = {c: unicodedata.normalize("NFD", c)[0] for c in letters if c == c.lower()}
    return {c: p for c, p in plain.items() if p != c and p.isascii() and p.isalpha()} | {"ø": "o", "đ": "d", "ł": "l"}


FOLDS = _folds()


def slug(text, empty: str = "challenge", longest: int = 64) -> Column:
    """Id made of a text's plain letters and digits; one that is too long ends in a short hash of
    the whole, so that long texts with a common beginning stay apart."""
    folded = F.translate(F.replace(F.lower(_c(text)), F.lit("œ"), F.lit("oe")), "".join(FOLDS), "".join(FOLDS.values()))
    cleaned = F.regexp_replace(F.regexp_replace(folded, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    short = F.concat(F.substring(cleaned, 1, longest - 9), F.lit("-"), F.substring(F.sha2(cleaned.cast("binary"), 256), 1, 8))
    return F.when(cleaned == "", F.lit(empty)).when(F.length(cleaned) > longest, short).otherwise(cleaned)


def is_own_export(name) -> Column:
    return F.coalesce(_c(name).rlike(OWN_EXPORT), F.lit(False))


def content_name(file_name, content) -> Column:
    """Library name of an imported file: cleaned stem and a short content hash."""
    name = _c(file_name)
    short_hash = F.substring(F.sha2(_c(content).cast("binary"), 256), 1, 8)
    stem = F.trim(F.regexp_replace(F.regexp_replace(name, r"\.[^./]*$", ""), r'[/\\:?%*|"<>\n\r\t]', " "))
    stem = F.when(stem == "", F.lit("Activity")).otherwise(stem)
    hashed = F.concat(F.lit("-"), short_hash)
    return (F.when(is_own_export(name), name)
            .when(stem.endswith(hashed), F.concat(stem, F.lit(".fit")))
            .otherwise(F.concat(F.substring(stem, 1, 60), hashed, F.lit(".fit"))))


def area_codes(code, name) -> Column:
    """STRUCT<country, local, label> of a country-prefixed area code."""
    code, name = _c(code), _c(name)
    local = F.when(F.instr(code, ":") > 0, F.regexp_replace(code, "^[^:]*:", "")).otherwise(code)
    return F.struct(F.substring_index(code, ":", 1).alias("country"), local.alias("local"),
                    F.when(name == local, local).otherwise(F.concat_ws(" ", local, name)).alias("label"))


# Least length times gradient of each climb category.
CLIMB_SCORES = [(80_000, "HC"), (64_000, "1"), (32_000, "2"), (16_000, "3"), (8_000, "4")]
CLIMB_RANKS = ["hill", "4", "3", "2", "1", "HC"]


def climb_category(length, avg) -> Column:
    length, avg = _c(length), _c(avg)
    result = F.when(avg < 3, F.lit(None).cast("string"))
    for limit, label in CLIMB_SCORES:
        result = result.when(length * avg >= limit, F.lit(label))
    return result.when((length >= 300) & (avg >= 5), F.lit("hill"))


def climb_rank(cat) -> Column:
    return F.array_position(F.array(*map(F.lit, CLIMB_RANKS)), _c(cat))


def scale_parse(value) -> Column:
    """A trail scale such as "1+" or "2-" as a number; null when it isn't one."""
    value = _c(value)
    shift = F.when(value.endswith("+"), F.lit(0.3)).when(value.endswith("-"), F.lit(-0.3)).otherwise(F.lit(0.0))
    bare = F.regexp_replace(value, "[+-]+$", "")
    return F.when(bare.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)\s*$"), F.trim(bare).try_cast("double") + shift)


# Posted difficulty words and route colours with their grade.
DIFFICULTY_GRADES = {"easy": 0, "novice": 0, "noviced": 0, "beginner": 0, "green": 0, "intermediate": 1, "blue": 1,
                     "advanced": 2, "red": 2, "difficult": 3, "expert": 3, "heavy": 3, "singletrail": 3, "black": 3}
COLOUR_GRADES = {"green": 0, "blue": 1, "red": 2, "black": 3}
COLOUR_COUNTRIES = ["FR", "CH", "AT"]
SIGNED_NETWORKS = ["lcn", "rcn", "ncn", "icn", "mtb"]
GRADE_NAMES = ["easy", "moderate", "hard", "very-hard"]


def _steps(value: Column, limits, last: int, inclusive_first: bool = False) -> Column:
    result = None
    for grade, limit in enumerate(limits):
        test = value <= limit if inclusive_first and grade == 0 else value < limit
        result = F.when(test, F.lit(grade)) if result is None else result.when(test, F.lit(grade))
    return result.otherwise(F.lit(last))


def route_grade(tags, country, metres, ascent, technical) -> Column:
    """STRUCT<grade, signposted>: posted difficulty, else IMBA scale, else colour, else effort."""
    tags, country = _c(tags), _c(country)

    def tag(key):
        return F.try_element_at(tags, F.lit(key))

    def grades(table):
        return F.create_map(*[F.lit(v) for item in table.items() for v in item])

    words = [F.try_element_at(grades(DIFFICULTY_GRADES), F.lower(tag(k))) for k in ("mtb:difficulty", "difficulty")]
    imba = scale_parse(tag("mtb:scale:imba"))
    posted = F.coalesce(*words, F.when(imba.isNotNull(), _steps(imba, (1, 3, 4), 3, True)),
                        F.when(country.isin(COLOUR_COUNTRIES), F.try_element_at(grades(COLOUR_GRADES), F.lower(tag("colour")))))
    effort = _steps(_c(metres) / 1000 + _c(ascent) / 100, (20, 40, 70), 3)
    hard = F.coalesce(_steps(_c(technical), (0.8, 1.5, 2.5), 3), F.lit(0))
    hard = F.when(_c(technical).isNull(), F.lit(0)).otherwise(hard)
    return F.struct(F.coalesce(posted, F.greatest(effort, hard)).alias("grade"), posted.isNotNull().alias("signposted"))


def is_signposted(tags) -> Column:
    """Signposted mountain bike route relations."""
    tags = _c(tags)

    def tag(key):
        return F.coalesce(F.try_element_at(tags, F.lit(key)), F.lit(""))

    return ((tag("type") == "route") & (tag("route") == "mtb") & tag("network").isin(SIGNED_NETWORKS)
            & (tag("unsigned") != "yes") & (tag("signed_route") != "no") & (tag("state") != "proposed")
            & ~F.contains(tag("state"), F.lit("disused")) & (tag("disused") != "yes")
            & ((tag("name") != "") | (tag("ref") != "")))


def is_usable_ferry(tags) -> Column:
    tags = _c(tags)

    def tag(key):
        return F.coalesce(F.try_element_at(tags, F.lit(key)), F.lit(""))

    return ((tag("route") == "ferry") & (tag("bicycle") != "no") & ~tag("access").isin("no", "private")
            & (tag("disused") != "yes") & (tag("abandoned") != "yes"))


def ferry_title(name, origin, target) -> Column:
    name, origin, target = (F.nullif(_c(c), F.lit("")) for c in (name, origin, target))
    return F.coalesce(name, F.when(origin != target, F.concat(origin, F.lit(" – "), target)),
                      F.concat(F.lit("Ferry at "), F.coalesce(origin, target)), F.lit("Ferry"))


def climb_title(name, place) -> Column:
    return F.coalesce(_c(name), F.concat(F.lit("Climb near "), _c(place)), F.lit("Climb"))


def sport_counts(sports, sport) -> Column:
    """Whether a challenge counts an activity: its sport is listed, or no sports are listed."""
    return _c(sports).isNull() | F.array_contains(_c(sports), _c(sport))


def local_time(ts, tz: str = "UTC") -> Column:
    return F.from_utc_timestamp(_c(ts), tz)


def local_day(ts, tz: str = "UTC") -> Column:
    return F.to_date(local_time(ts, tz))


def seconds(ts) -> Column:
    """Seconds since 1970 as a double."""
    return F.unix_micros(_c(ts)) / F.lit(1e6)
