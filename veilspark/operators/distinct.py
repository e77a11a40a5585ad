"""Stand-ins of which no two values share one: permutations of what has a form, wide keyed draws of what has none.

Numbers, addresses of machines and ids of all kinds go through the permutation of their form (``functions.permute``): they are apart by construction, in batches and
in streams alike, and nothing is ranked or remembered. Names, handles and mailboxes have no form to permute; they are drawn from domains of 10**12 and more, so that equal draws
are rare. In a batch the few that meet are gathered by stand-in and numbered, groups of a handful however many values there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import draw, keys, permute
from ..sources.scratch import Scratch, dealt

# Parts of invented names.
ONSETS = "b br c d dr f g gr h k l m n p r s st t tr v w".split()
VOWELS = "a e i o u".split()
CODAS = "l ll m n nd r rd rn s sk".split()
ENDINGS = "berg by combe den field ford gate ham hurst ley man mere more ridge shaw stead ton well wick worth".split()
#: Kinds that are drawn; the value's spelling is folded, so its letters' case does not matter.
DRAWN = ("PERSON", "FIRST_NAME", "LAST_NAME", "EMAIL_ADDRESS", "USERNAME", "EMPLOYER", "ADDRESS")


def _pick(hexes: Column, at: int, items: list[str]) -> Column:
    return F.element_at(keys.literals(items), (draw.number(hexes, at, 4) % len(items) + 1).cast("int"))


def surname(hexes: Column, at: int = 0, syllables: int = 3) -> Column:
    """An invented surname from ``12 * syllables + 4`` hexadecimal digits."""
    parts = [_pick(hexes, at + 12 * i + 4 * j, items) for i in range(syllables) for j, items in enumerate((ONSETS, VOWELS, CODAS))]
    return F.initcap(F.concat(*parts, _pick(hexes, at + 12 * syllables, ENDINGS)))


def _name(original: Column, hexes: Column) -> Column:
    canonical = F.trim(F.regexp_replace(original, r"\s+", " "))
    first, last = _pick(hexes, 44, draw.FIRST), surname(hexes)
    full = F.concat_ws(" ", first, _pick(hexes, 48, draw.FIRST), last)
    made = F.when(canonical.contains(","), F.concat_ws(", ", last, first)).when(canonical.contains(" "), full).otherwise(last)
    return F.when((original == F.upper(original)) & original.rlike(r"\p{Lu}"), F.upper(made)).otherwise(made)


def _mailbox(original: Column, hexes: Column) -> Column:
    local = F.when(draw.role_mailbox(original), F.concat(F.lower(F.substring_index(original, "@", 1)), F.lit("."), F.substring(hexes, 53, 8)))
    name = F.concat_ws(".", F.lower(_pick(hexes, 44, draw.FIRST)), F.lower(surname(hexes)), draw.number(hexes, 52, 4).cast("string"))
    return F.concat(F.coalesce(local, name), F.lit("@"), _pick(hexes, 60, list(draw.DOMAINS)))


def _drawn(entity: str, original: Column, hexes: Column) -> Column:
    if entity in ("PERSON", "LAST_NAME"):
        return _name(original, hexes)
    if entity == "FIRST_NAME":
        return surname(hexes, syllables=2)
    if entity == "EMAIL_ADDRESS":
        return _mailbox(original, hexes)
    if entity == "USERNAME":
        return F.concat(F.lower(_pick(hexes, 44, draw.FIRST)), F.lower(surname(hexes, syllables=2)), draw.number(hexes, 48, 6).cast("string"))
    if entity == "EMPLOYER":
        form = F.regexp_extract(original, r"(?i)\b(inc|llc|ltd|gmbh|ag|sa|bv|plc|corp|co)\b\.?$", 0)
        return F.trim(F.concat_ws(" ", surname(hexes), F.when(form != "", form)))
    kind = F.regexp_extract(original, r"(?i)\b(street|st|avenue|ave|road|rd|lane|ln|drive|dr|boulevard|blvd|court|ct|way|place|pl|square|sq|box)\b\.?", 1)
    return F.concat_ws(" ", (draw.number(hexes, 48) % 9899 + 100).cast("string"), surname(hexes), F.when(kind != "", kind).otherwise(F.lit("Street")))


def stand_ins(values: DataFrame, seed: str) -> DataFrame:
    """(scope, entity, original, stand_in) of each distinct value of ``values`` (scope, entity, original); it depends on nothing but the value."""
    values = dealt(values.select("scope", "entity", "original").distinct(), "original")  # last: drawing costs more than its few bytes tell
    entity, original, scope = F.col("entity"), F.col("original"), F.col("scope")
    other = [k for k in draw.DRAWS if k in draw.COARSE and k != "SECRET"]
    kept = F.col("entity").isin(*DRAWN, *other) | ((entity == "SECRET") & ~original.rlike("^[0-9]{1,15}$"))
    made = values.withColumn("formed", permute.stand_in(entity, F.when(~kept, original), scope, seed))
    folded = F.lower(F.trim(F.regexp_replace(original, r"\s+", " ")))
    out = draw.secret(original, seed, scope)
    for kind in other:
        out = F.when(entity == kind, draw.DRAWS[kind](original, seed, scope)).otherwise(out)
    for kind in DRAWN:
        out = F.when(entity == kind, _drawn(kind, original, draw.stream(seed, scope, kind, folded))).otherwise(out)
    return made.select("scope", "entity", "original", F.coalesce("formed", out).alias("stand_in"))


def met(drawn: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``drawn`` with the drawn kinds apart too: where values met, all but the first get a number.

    Spellings of one value that differ in case or spaces alone are one value. Equal draws are as rare as their domains are wide, so a group is a few values. Where values may have met is told
    by hashes, so that what is shuffled of all values is two numbers each; only the few that are named go through with their texts.
    """
    scratch = scratch or Scratch(drawn.sparkSession)
    folded = F.lower(F.trim(F.regexp_replace("original", r"\s+", " ")))
    wide = drawn.where(F.col("entity").isin(*DRAWN)).withColumn("same", folded)
    place, low = F.xxhash64("scope", "entity", F.lower("stand_in")), F.lower("stand_in").alias("low")
    hashed = wide.select(place.alias("place"), F.xxhash64("same").alias("h")).groupBy("place").agg(F.min("h").alias("least"), F.max("h").alias("most"))
    some = scratch.save(hashed.where("least <> most").select("place"), "met-places")
    several = wide.withColumn("place", place).join(some, "place", "left_semi").groupBy("scope", "entity", low).agg(F.array_sort(F.collect_set("same")).alias("all")).where("size(all) > 1")
    told = scratch.save(several.select("scope", "entity", F.posexplode("all").alias("k", "same")).where("k > 0"), "met-told")
    rest = drawn.withColumn("same", folded).join(told, ["scope", "entity", "same"], "left")
    return rest.select("scope", "entity", "original", draw.widened(F.col("entity"), F.col("stand_in"), F.coalesce("k", F.lit(0))).alias("stand_in"))


def _of_both(one: DataFrame, other: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(scope, low) that two tables of (scope, low) both have: by hashes first, then by the texts of the few that these name."""
    place = F.xxhash64("scope", "low").alias("place")
    sides = one.select(place, F.lit(1).alias("side")).union(other.select(place, F.lit(2).alias("side")))
    places = scratch.save(sides.groupBy("place").agg(F.min("side").alias("a"), F.max("side").alias("b")).where("a < b").select("place"), f"{name}-places")
    held = lambda df: df.where("low is not null").withColumn("place", F.xxhash64("scope", "low")).join(places, "place", "left_semi").select("scope", "low")
    return held(one).join(held(other), ["scope", "low"], "left_semi").distinct()


def settled(drawn: DataFrame, originals: DataFrame, seed: str, scratch: Scratch, turns: int = 4) -> DataFrame:
    """``drawn`` with no stand-in that is an original of its scope.

    Those that are move on along the permutation of their shape under the keys of further turns, each turn an equi-join of the few that are left with the originals and with
    what is taken. What no turn settles (forms of which all values are taken) is told by a mark at its end.
    """
    known = originals.select("scope", F.lower("original").alias("low"))
    coarse = F.col("entity").isin(*draw.COARSE)

    def split(df: DataFrame, taken: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
        lowered = df.withColumn("low", F.lower("stand_in"))
        both = scratch.save(_of_both(lowered.select("scope", "low"), taken, scratch, f"both-{turn}"), f"both-{turn}")
        hit = lowered.join(both.withColumn("hit", F.lit(True)), ["scope", "low"], "left")
        hit = scratch.save(hit.select("scope", "entity", "original", "stand_in", (F.coalesce("hit", F.lit(False)) & ~(coarse & (F.lower("stand_in") != F.lower("original")))).alias("hit")), f"settled-{turn}")
        return hit.where("not hit").drop("hit"), hit.where("hit").drop("hit")

    drawn = scratch.save(drawn, "unsettled")
    done, left = split(drawn, known, 0)
    for turn in range(1, turns + 1):
        if left.isEmpty():
            return done
        again = left.withColumn("stand_in", permute.stand_in(F.lit(f"TURN_{turn}"), F.col("stand_in"), F.col("scope"), seed))
        taken = known.union(done.select("scope", F.lower("stand_in")))
        more, left = split(scratch.save(again, f"again-{turn}"), taken, turn)
        done = done.unionByName(more)
    return done.unionByName(left.withColumn("stand_in", F.concat("stand_in", F.lit("-x"))))


def personas(persons: DataFrame, seed: str) -> DataFrame:
    """(scope, person, who) of ``persons`` (scope, person): what all of a person's names, handles and mailboxes are made of; no two persons have one name."""
    hexes = draw.stream(seed, F.col("scope"), "PERSONA", F.lower("person"))
    made = persons.select("scope", "person").distinct().select("scope", "person", _pick(hexes, 44, draw.FIRST).alias("first"), surname(hexes).alias("last"), (draw.number(hexes, 52) % 10000).alias("number"))
    several = made.groupBy("scope", "first", "last").agg(F.array_sort(F.collect_set("person")).alias("all")).where("size(all) > 1")
    told = several.select("scope", F.posexplode("all").alias("k", "person")).where("k > 0")
    last = draw.widened(F.lit("LAST_NAME"), F.col("last"), F.coalesce("k", F.lit(0)))
    return made.join(told, ["scope", "person"], "left").select("scope", "person", F.struct("first", last.alias("last"), "number").alias("who"))
