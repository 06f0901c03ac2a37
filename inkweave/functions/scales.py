"""The letter scale: a to z for confidence and relevance, letters for relations, and their codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Relations, their letters and their order of preference.
RELATION_LETTERS = {"proves": "p", "extends": "e", "assumes": "s", "uses_definition": "d", "contradicts": "c", "prerequisite": "r", "equivalent": "q", "missing_proof": "m", "annotates": "n"}
RELATION_RANKS = {"proves": 100, "extends": 90, "prerequisite": 85, "equivalent": 80, "contradicts": 75, "uses_definition": 70, "assumes": 60, "missing_proof": 50, "annotates": 40}


def _map(pairs) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs for x in pair])


def letter_index(letter: Column) -> Column:
    """1 to 26 for a single letter, else null."""
    return F.when(F.regexp_like(letter, F.lit("^[A-Za-z]$")), F.ascii(F.lower(letter)) - 96)


def index_letter(index: Column) -> Column:
    return F.when(index.between(1, 26), F.char(index.cast("long") + 96))


def fraction_letter(f: Column) -> Column:
    """a to z for 0 to 1, z the best."""
    return F.when(f.isNull() | F.isnan(f) | (f <= 0), "a").when(f >= 1, "z").otherwise(index_letter(F.greatest(F.lit(1), F.least(F.lit(26), F.ceil(f * 26)))))


def letter_fraction(letter: Column) -> Column:
    """The middle of a letter's share of 0 to 1; 0 for no letter."""
    return F.coalesce((letter_index(letter) - 0.5) / 26, F.lit(0.0))


def path_weight(letter: Column) -> Column:
    """1 for z to 26 for a; 26 for no letter."""
    return F.coalesce(27 - letter_index(F.substring(letter, 1, 1)), F.lit(26)).cast("int")


def relation_letter(relation: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(RELATION_LETTERS.items()), relation), F.lit("s"))


def letter_relation(letter: Column) -> Column:
    return F.coalesce(F.try_element_at(_map((v, k) for k, v in RELATION_LETTERS.items()), F.lower(letter)), F.lit("assumes"))


def relation_rank(relation: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(RELATION_RANKS.items()), relation), F.lit(0))


def role_relation(role: Column) -> Column:
    return F.when(role.isin("proof", "result"), "extends").when(role == "definition", "uses_definition").otherwise("assumes")


def overlap_letter(n: Column, best: str = "a") -> Column:
    """The letter of an overlap; best says which end of the alphabet is the better one ("a" as edges store it, or "z")."""
    letters = ["a", "c", "f", "j", "z"] if best == "a" else ["z", "x", "u", "q", "a"]
    return F.when(n >= 4, letters[0]).when(n == 3, letters[1]).when(n == 2, letters[2]).when(n == 1, letters[3]).otherwise(letters[4])


def low_is_best_rank(letter: Column) -> Column:
    """26 for a to 1 for z, 0 for none: the order of letters where a is best."""
    return F.coalesce(27 - letter_index(letter), F.lit(0))


def cosine_letter(cosine: Column) -> Column:
    return F.when(cosine >= 0.85, "a").when(cosine >= 0.80, "c").when(cosine >= 0.75, "f").otherwise("j")


def tier(letter: Column, middle: str = "j") -> Column:
    """high from s, mid from j (audits) or k (displays), low below; unknown without a letter."""
    c = F.lower(letter)
    return F.when(c.isNull() | (c == ""), "unknown").when(c >= "s", "high").when(c >= middle, "mid").otherwise("low")


def percent(letter: Column) -> Column:
    """Share of the scale up to and with a letter, in whole percent."""
    return F.round((letter_index(letter)) * 100 / 26).cast("int")


def decode_ranking(text: Column) -> Column:
    """array<struct<index,confidence,fraction>> of two-letter tokens."""
    pairs = F.filter(F.split(F.coalesce(text, F.lit("")), "[^a-zA-Z]+"), lambda t: F.length(t) == 2)
    return F.transform(pairs, lambda t: F.struct(letter_index(F.substring(t, 1, 1)).alias("index"), F.lower(F.substring(t, 2, 1)).alias("confidence"), letter_fraction(F.substring(t, 2, 1)).alias("fraction")))


def encode_ranking(entries: Column) -> Column:
    return F.array_join(F.transform(entries, lambda e: F.concat(index_letter(e["index"]), e["confidence"])), " ")


def decode_classification(text: Column) -> Column:
    """array<struct<relation,confidence,relevance,fraction>> of groups of three letters; a rest is dropped."""
    groups = F.regexp_extract_all(F.regexp_replace(F.coalesce(text, F.lit("")), "[^a-zA-Z]", ""), F.lit("(...)"), F.lit(1))
    at = lambda g, k: F.lower(F.substring(g, k, 1))
    return F.transform(groups, lambda g: F.struct(letter_relation(at(g, 1)).alias("relation"), at(g, 2).alias("confidence"), at(g, 3).alias("relevance"), letter_fraction(at(g, 2)).alias("fraction")))


def decode_pick(text: Column) -> Column:
    """struct<rejected,index,relation,confidence,relevance> of a four-letter verdict; null if it is too short."""
    t = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[^a-zA-Z]", ""))
    rejected = t.startswith("x")
    at = lambda k: F.when(~rejected, F.substring(t, k, 1))
    verdict = F.struct(rejected.alias("rejected"), letter_index(at(1)).alias("index"), F.when(~rejected, letter_relation(at(2))).alias("relation"), at(3).alias("confidence"), at(4).alias("relevance"))
    return F.when(F.length(t) >= 4, verdict)


def passes_floor(confidence: Column, relevance: Column, floor: str = "f", product: float = 0.10) -> Column:
    """Whether an edge's letters are both at the floor or above and their fractions' product is large enough."""
    c, r = F.coalesce(confidence, F.lit("a")), F.coalesce(relevance, F.lit("a"))
    return (c >= floor) & (r >= floor) & (letter_fraction(c) * letter_fraction(r) >= product)
