"""Product names, brands, specifications and signatures, and review text features, as Columns."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


@functools.cache
def accents() -> tuple[str, str]:
    """Letters with marks and the letters that they become: single-letter decompositions up to Latin Extended Additional."""
    pairs = [(chr(i), unicodedata.normalize("NFKD", chr(i))) for i in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]]
    bare = [(a, "".join(c for c in b if not unicodedata.combining(c))) for a, b in pairs]
    bare = [(a, b) for a, b in bare if len(b) == 1 and a != b]
    return "".join(a for a, _ in bare), "".join(b for _, b in bare)


def first_match(text: Column, patterns: list[str], group: int) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, group), F.lit("")) for p in patterns])


def normalize_name(name: Column) -> Column:
    """Lower-case letters without marks, digits and ``- _ . /``, single spaces; null gives ''."""
    plain = F.lower(F.translate(F.coalesce(name, F.lit("")), *accents()))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9\s\-_./]", " "), r"\s+", " "))


def extract_brand(name: Column) -> Column:
    """The longest known brand that stands as words of its own (then by name), else a first word of over two letters, else Unknown."""
    low = F.lower(F.coalesce(name, F.lit("")))
    listed = "|".join(sorted(fixed.BRANDS, key=lambda b: (-len(b), b)))
    found = F.regexp_extract_all(low, F.lit(rf"\b({listed})\b"), F.lit(1))
    best = F.array_sort(F.transform(found, lambda b: F.struct((-F.length(b)).alias("n"), b.alias("b"))))
    first = F.split(F.trim(low), r"\s+")[0]
    return F.coalesce(F.upper(F.get(best, 0)["b"]), F.when(first.rlike(r"^\p{L}{3,}$"), F.upper(first)), F.lit("Unknown"))


def extract_model(normalized: Column, brand: Column) -> Column:
    """Up to three words of the first six before a specification word, without the brand, upper-case; null if none."""
    rest = F.when(brand != "Unknown", F.trim(F.replace(normalized, F.lower(brand), F.lit("")))).otherwise(normalized)
    words = F.slice(F.filter(F.split(rest, r"\s+"), lambda w: w != ""), 1, 6)
    stops = F.array(*[F.lit(w) for w in fixed.MODEL_STOPWORDS])
    marked = F.transform(words, lambda w, i: F.when(F.array_contains(stops, w), i).otherwise(F.lit(6)))
    before = F.slice(words, F.lit(1), F.coalesce(F.array_min(marked), F.lit(0)))
    good = F.slice(F.filter(before, lambda w: (F.length(w) > 1) & w.rlike("[a-z0-9]")), 1, 3)
    return F.nullif(F.upper(F.array_join(good, " ")), F.lit(""))


def categorize(normalized: Column) -> Column:
    out = F.lit("Other")
    for name, words in reversed(fixed.CATEGORY_KEYWORDS.items()):
        out = F.when(functools.reduce(lambda a, b: a | b, [normalized.contains(w) for w in words]), F.lit(name)).otherwise(out)
    return out


def extract_specs(text: Column) -> dict[str, Column]:
    low = F.lower(text)
    storage = F.upper(F.regexp_replace(first_match(low, fixed.STORAGE_PATTERNS, 0), r"\s+", " "))
    return {
        "processor": first_match(low, fixed.PROCESSOR_PATTERNS, 0),
        "ram": F.concat(first_match(low, fixed.RAM_PATTERNS, 1), F.lit("GB")),
        "storage": storage,
        "screen": F.concat(first_match(low, fixed.SCREEN_PATTERNS, 1), F.lit(" inch")),
    }


def specs_map(specs: dict[str, Column]) -> Column:
    return F.map_filter(F.create_map(*[x for k, v in specs.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())


def signature(brand: Column, model: Column, specs: dict[str, Column]) -> Column:
    """brand_model_processor_ram_storage_screen of what is known, at most 100 characters, else unknown."""
    bare = lambda c: F.nullif(F.regexp_replace(F.lower(c), "[^a-z0-9]", ""), F.lit(""))
    storage = F.lower(specs["storage"])
    size = F.nullif(F.regexp_extract(storage, r"(\d+)\s*(?:gb|tb)", 1), F.lit(""))
    kind = F.when(storage.contains("ssd"), "ssd").when(storage.contains("hdd"), "hdd").otherwise("")
    parts = [
        F.when(brand != "Unknown", bare(brand)),
        F.substring(bare(model), 1, 15),
        F.replace(F.nullif(F.regexp_extract(F.lower(specs["processor"]), fixed.SIGNATURE_PROCESSOR, 1), F.lit("")), F.lit(" "), F.lit("")),
        F.concat(F.nullif(F.regexp_extract(specs["ram"], r"(\d+)", 1), F.lit("")), F.lit("gb")),
        F.concat(size, F.when(storage.contains("tb"), "tb").otherwise("gb"), kind),
        F.concat(F.nullif(F.regexp_extract(specs["screen"], r"(\d+(?:\.\d)?)", 1), F.lit("")), F.lit("in")),
    ]
    return F.coalesce(F.nullif(F.substring(F.concat_ws("_", *parts), 1, 100), F.lit("")), F.lit("unknown"))


def title_specs(title: Column, shop: str = "") -> dict[str, Column]:
    """processor, gpu, ram_gb, storage and screen_size of a shop's titles; ``listed`` is the shop with French titles."""
    if shop == "listed":
        found = {k: first_match(title, p, 1) for k, p in fixed.LISTED_PATTERNS.items()}
        unit = first_match(title, fixed.LISTED_PATTERNS["storage"], 2)
        found["storage"] = F.concat(found["storage"], F.lit(" "), unit, F.lit(" SSD"))
    else:
        found = {k: first_match(title, p, 1) for k, p in fixed.TITLE_PATTERNS.items()}
    return found | {"ram_gb": found["ram_gb"].cast("int"), "screen_size": F.concat(found["screen_size"], F.lit('"'))}


def product_id_from_url(url: Column) -> Column:
    return F.coalesce(first_match(url, [r"/(\d+)\.html", r"/(\d+)-", r"/p/(\d+)"], 1), F.substring(F.md5(url.cast("binary")), 1, 8))


def is_blocked(html: Column) -> Column:
    low = F.lower(html)
    return functools.reduce(lambda a, b: a | b, [low.contains(w) for w in fixed.BLOCK_INDICATORS])


def is_missing_page(html: Column) -> Column:
    """Whether a page says, in these very words, that it was not found."""
    return functools.reduce(lambda a, b: a | b, [html.contains(w) for w in fixed.NOT_FOUND])


def shop_brand(title: Column) -> Column:
    """A brand of the shop abroad at the start of a title, upper-case; null if none."""
    return F.upper(F.nullif(F.regexp_extract(title, fixed.SHOP_BRAND, 1), F.lit("")))


def pagination_id(href: Column) -> Column:
    return F.nullif(F.regexp_extract(href, r"[?&]id=(\d+)", 1), F.lit(""))


def absolute_url(url: Column, base: str) -> Column:
    return F.when(url.startswith("http"), url).otherwise(F.concat(F.lit(base), url))


def token_jaccard(a: Column, b: Column) -> Column:
    x, y = (F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")) for c in (a, b))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def clean_review(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    for pattern, by in ((r"http\S+|www\S+", ""), (r"\S+@\S+", ""), (r"<.*?>", ""), (r"[^a-z0-9\s.!?,']", " "), (r"\s+", " ")):
        low = F.regexp_replace(low, pattern, by)
    return F.trim(low)


def review_features(text: Column, ascii_only: bool = False) -> dict[str, Column]:
    """Counts and ratios of a review's text; a null text counts as empty. ``ascii_only`` takes A-Z and a-z alone as letters."""
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    letters, upper, digit = ("^[A-Za-z]+$", "[A-Z]", "[0-9]") if ascii_only else (r"^\p{L}+$", r"\p{Lu}", r"\p{Nd}")
    alpha = F.filter(words, lambda w: w.rlike(letters))
    count = lambda p: F.regexp_count(t, F.lit(p)).cast("long")
    n, chars = F.size(words).cast("long"), F.char_length(t).cast("long")
    return {
        "text_length": chars,
        "word_count": n,
        "avg_word_length": F.round(chars / F.greatest(n, F.lit(1)), 6),
        "exclamation_count": count("!"),
        "question_count": count(r"\?"),
        "capital_ratio": F.round(count(upper) / F.greatest(chars, F.lit(1)), 6),
        "digit_count": count(digit),
        "unique_word_ratio": F.round(F.size(F.array_distinct(alpha)) / F.greatest(F.size(alpha), F.lit(1)), 6),
        "sentence_count": F.greatest(count("[.!?]"), F.lit(1)),
        "is_very_short": (n < 20).cast("int"),
        "is_very_long": (n > 150).cast("int"),
    }


def sentiment(text: Column) -> dict[str, Column]:
    """Polarity from -1 to 1 and subjectivity from 0 to 1: means over the opinion words of a text, 0 without any.

    The reference library for this is not at hand, so the words are those of a small lexicon of our own.
    """
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+")
    among = lambda listed: F.size(F.filter(words, lambda w: w.isin(*listed)))
    counts = {v: among(listed) for v, listed in fixed.OPINIONS.items()}
    total = functools.reduce(lambda a, b: a + b, counts.values())
    mean = lambda value: F.coalesce(F.round(F.try_divide(functools.reduce(lambda a, b: a + b, [c * F.lit(value(v)) for v, c in counts.items()]), total), 6), F.lit(0.0))
    return {"sentiment_polarity": mean(lambda v: v), "sentiment_subjectivity": mean(lambda v: fixed.SUBJECTIVITY[abs(v)])}


def phrase_sentiment(text: Column) -> Column:
    """(sentiment_polarity, sentiment_subjectivity, opinions, negated) by phrases, as a struct: polarity from -1 to 1 and
    subjectivity from 0 to 1 are means over opinion words, each as the words before it make it, 0 without any.

    A fold over the words carries the state of the phrase. A strengthening or weakening word counts for the word right
    after it and these add up ("very, very good"); a negation reaches NEGATION_REACH words, up to the next opinion or the
    end of the sentence, and leaves NEGATED of the opinion ("not very good" is a weak dislike). A null text counts as empty.
    """
    words = F.regexp_extract_all(F.translate(F.lower(F.coalesce(text, F.lit(""))), "\u2019", "'"), F.lit(fixed.WORD_OR_END), F.lit(1))
    # each word as a number: the value of an opinion, else one of these, else 0
    other, end, strong, weak, negation = (F.lit(float(n)) for n in (0, 10, 11, 12, 13))
    listed = [([".", "!", "?", ";"], end), (fixed.STRONGER, strong), (fixed.WEAKER, weak), (fixed.NEGATIONS, negation), *[(ws, F.lit(v)) for v, ws in fixed.OPINIONS.items()]]
    codes = F.transform(words, lambda w: functools.reduce(lambda rest, ws: F.when(w.isin(*ws[0]), ws[1]).otherwise(rest), listed, other))
    kinds = {"strong": "int", "weak": "int", "reach": "int", "polarity": "double", "subjectivity": "double", "opinions": "long", "negated": "long"}
    zeros = {k: F.lit(0).cast(t) for k, t in kinds.items()}
    state = lambda **new: F.struct(*[new[k].cast(t).alias(k) for k, t in kinds.items()])

    def step(s: Column, v: Column) -> Column:
        opinion, turned = F.abs(v).between(0.01, 1.0), s["reach"] > 0
        by = F.pow(F.lit(fixed.STRONGER_BY), s["strong"]) * F.pow(F.lit(fixed.WEAKER_BY), s["weak"])
        said = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v * by * F.when(turned, F.lit(fixed.NEGATED)).otherwise(F.lit(1.0))))
        subjective = functools.reduce(lambda rest, kv: F.when(F.abs(v) == kv[0], F.lit(kv[1])).otherwise(rest), fixed.SUBJECTIVITY.items(), F.lit(0.0))
        add = lambda name, by, more: s[name] + F.when(by, more).otherwise(0)
        return state(
            strong=F.when(v == strong, s["strong"] + 1).when(v == weak, s["strong"]).otherwise(0),
            weak=F.when(v == weak, s["weak"] + 1).when(v == strong, s["weak"]).otherwise(0),
            reach=F.when(v == negation, fixed.NEGATION_REACH).when(opinion | (v == end), 0).otherwise(F.greatest(F.lit(0), s["reach"] - 1)),
            polarity=add("polarity", opinion, said),
            subjectivity=add("subjectivity", opinion, F.least(F.lit(1.0), subjective * by)),
            opinions=add("opinions", opinion, 1),
            negated=add("negated", opinion & turned, 1),
        )

    def means(s: Column) -> Column:
        mean = lambda c: F.coalesce(F.round(F.try_divide(s[c], s["opinions"]), 6), F.lit(0.0)).alias(f"sentiment_{c}")
        return F.struct(mean("polarity"), mean("subjectivity"), s["opinions"].alias("opinions"), s["negated"].alias("negated"))

    return F.aggregate(codes, state(**zeros), step, means)


def rating_features(rating: Column) -> dict[str, Column]:
    """A missing rating counts as 3."""
    return {"rating": F.coalesce(rating, F.lit(3)), "is_extreme_rating": F.coalesce(rating.isin(1, 5), F.lit(False)).cast("int")}


def sentiment_label(polarity: Column) -> Column:
    return F.when(polarity > 0, "positive").when(polarity < 0, "negative").otherwise("neutral")


def detect_language(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    chars = F.char_length(F.replace(t, F.lit(" "), F.lit("")))
    french = functools.reduce(lambda a, b: a + b, [F.lower(t).contains(w).cast("int") for w in fixed.FRENCH_WORDS])
    return F.when(chars == 0, "unknown").when(F.regexp_count(t, F.lit("[\\u0600-\\u06FF]")) / chars > 0.3, "ar").when(french > 2, "fr").otherwise("en")
