"""Mapping freely typed values to the entries of a reference list, in built-in SQL functions only.

Both sides are brought to one spelling: lower case, no accents, no outer punctuation, "b, a" read as "a b". A spelling has two parts.
`strict` holds what must be equal: numbers, Greek letters and the class words of the list (kinase and ligase are two edits apart and not the
same). Class words are learned from the reference list: words that many entries share and that stand beside many different rarer words. Short
forms of them (kin. for kinase) are recognised by their letters. `letters` holds all other letters, which may differ by at most k edits: none below
three letters, one below six. Values of a code shape (symbols, accessions) allow no edit, and a value of signs only stands for itself.

Candidates come from a pigeonhole join, for every entry: its letters are cut into one segment more than it allows edits; the edits leave one
segment intact, so the input must hold that segment within that many places of its own position. The segments are
an equality key together with strict and the entry's length. Each candidate is checked with the built-in levenshtein; inputs
without one come out through an anti-join.

Work is done once per distinct spelling, so a value that a third of all rows hold costs one row. The
segments of the reference list are broadcast only while their measured size allows it. Null and empty inputs
are unmatched. Of several entries the nearest wins; a tie between different entries is unmatched too, as the input stands for
none of them alone, and is told apart by `why`. Repeated rows keep their own row each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.session import cut, maybe_broadcast

#: Ways of writing letters and numbers.
ACCENTED, PLAIN = "àáâãäåèéêëìíîïòóôõöùúûüçñýÿıø", "aaaaaaeeeeiiiiooooouuuucnyyio"
GREEK_LETTERS = {"α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "ζ": "zeta", "η": "eta", "θ": "theta", "κ": "kappa", "λ": "lambda", "μ": "mu", "π": "pi", "σ": "sigma", "τ": "tau", "φ": "phi", "χ": "chi", "ψ": "psi", "ω": "omega"}
NUMBER_WORDS = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve"]
ROMAN = ["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii"]

#: A class word stands in this share of the entries and beside this many different rarer words. At most words-per-entry / CLASS_SHARE words qualify.
CLASS_SHARE, CLASS_PARTNERS = 0.005, 5

_SPACE = r"[\s\u00a0]+"


def _tidy(text: Column, labels: Sequence[str], added: Sequence[str]) -> Column:
    """Lower case without accents, labels ("symbol: x"), added words and outer punctuation."""
    s = F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED, PLAIN)
    s = F.trim(F.regexp_replace(s, _SPACE, " "))
    if labels:
        s = F.regexp_replace(s, rf"^[\"'(\[<]*\s*(?:{'|'.join(labels)})\s*[:=|]\s*", "")
    s = F.regexp_replace(s, r"(?<=\d)(?:\.\d+)?(?:\|\w*|:(?:pep|cds))$", "")
    if added:
        s = F.regexp_replace(s, rf"(?<![a-z])(?:{'|'.join(added)})(?![a-z])", " ")
    s = F.regexp_replace(s, r"[(\[]\s*[)\]]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"^[^\p{L}\d]+|[^\p{L}\d)\]]+$", ""), _SPACE, " "))


def _code(tidy: Column) -> Column:
    """Symbol or accession: letters, digits and at most one letter, without separators and version; else null."""
    bare = F.regexp_replace(tidy, r"^[(\[]+|[)\]]+$", "")
    shape = r"^([a-z]{2,6})[ _.\-]?(\d{1,12})(?:[ _.\-]?([a-z]))?(?:\.\d{1,3})?$"
    parts = F.concat(F.regexp_extract(bare, shape, 1), F.regexp_extract(bare, shape, 2), F.regexp_extract(bare, shape, 3))
    return F.when(F.length(parts) > 0, parts)


def _words(tidy: Column) -> Column:
    """The words of a value in the list's order, a number at the end in digits."""
    s = tidy
    for letter, word in GREEK_LETTERS.items():
        s = F.replace(s, F.lit(letter), F.lit(f" {word} "))
    # digits inside a word are misread letters; digits after a word are its number
    inside = r"(?:(?<=[a-z]){0}(?=[a-z])|(?<=[a-z]{{3}}){0}(?=[ _/-][a-z]{{3}})|(?<![a-z0-9.]){0}(?=[a-z]{{3}}))"
    s = F.regexp_replace(F.regexp_replace(s, inside.format("0"), "o"), inside.format("1"), "l")
    s = F.regexp_replace(s, r"(?<=\p{L})(?=\d)", " ")
    # "b, a" is "a b", but where the number is already last
    ends = rf",.*[^\p{{L}}\d](?:\d+|{'|'.join(NUMBER_WORDS)}|{'|'.join(ROMAN)})[^\p{{L}}\d]*$"
    s = F.when(s.rlike(ends), s).otherwise(F.regexp_replace(s, r"^([^,]*[^\s,])\s*,\s*([^,]*\p{L}{4,}[^,]*)$", "$2 $1"))
    words = F.filter(F.split(F.regexp_replace(s, r"[^\p{L}\d]+", " "), " "), lambda w: F.length(w) > 0)
    numbers = F.create_map(*[F.lit(x) for ws in (NUMBER_WORDS, ROMAN) for i, w in enumerate(ws) for x in (w, str(i + 1))])
    last = F.try_element_at(words, F.lit(-1))
    number = F.coalesce(F.try_element_at(numbers, last), F.regexp_replace(last, r"^0+(?=\d)", ""))
    return F.when(F.size(words) > 0, F.concat(F.slice(words, 1, F.size(words) - 1), F.array(number))).otherwise(F.array().cast("array<string>"))


def _read(df: DataFrame, text: str, labels: Sequence[str], added: Sequence[str]) -> DataFrame:
    """df with (code, words)."""
    return df.withColumn("_t", _tidy(F.col(text), labels, added)).withColumn("code", _code(F.col("_t"))).withColumn("words", F.when(F.col("code").isNull(), _words(F.col("_t")))).withColumn("sign", F.trim(F.lower(F.col(text)))).drop("_t")


def class_words(entries: DataFrame) -> list[str]:
    """Words that many entries share and that stand beside many different words rarer than themselves; a short list by the bound on the share."""
    named = entries.filter("code is null").select("ref", F.array_distinct("words").alias("words"))
    total = entries.count()
    flat = named.select("ref", F.explode("words").alias("w")).filter(F.col("w").rlike(r"^\p{L}{3,}$"))
    counts = flat.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    often = counts.filter((F.col("n") >= F.lit(CLASS_SHARE) * total) & (F.col("n") >= CLASS_PARTNERS))
    sized = flat.join(counts, "w")
    one = sized.join(often.select("w"), "w", "left_semi")
    pairs = one.join(sized.select("ref", F.col("w").alias("w2"), F.col("n").alias("n2")), "ref").filter("n2 < n").select("w", "w2").distinct()
    wide = pairs.groupBy("w").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") >= CLASS_PARTNERS)
    return sorted(r.w for r in wide.select("w").collect())


def _long_forms(read: DataFrame, key: str, vocabulary: Sequence[str]) -> DataFrame:
    """(key, long): for values with short forms of class words, a map from each to the one class word it stands for.

    A short form is the beginning of a class word, or else its letters in order from the first one on; one that fits several
    class words stands for none. Every distinct word is looked at once.
    """
    flat = read.select(key, F.explode("words").alias("w")).filter(F.col("w").rlike(r"^\p{L}{2,}$") & ~F.col("w").isin([*GREEK_LETTERS.values(), *vocabulary]))
    tried = flat.select("w").distinct().select("w", F.explode(F.array(*map(F.lit, vocabulary))).alias("v"))
    tried = tried.filter((F.substring("v", 1, 1) == F.substring("w", 1, 1)) & (F.length("v") > F.length("w"))).withColumn("begins", F.col("v").startswith(F.col("w")))
    fits = tried.filter(F.col("begins") | F.rlike("v", F.array_join(F.split("w", F.lit("")), ".*"))).groupBy("w")
    found = fits.agg(F.count_if("begins").alias("nb"), F.min(F.when(F.col("begins"), F.col("v"))).alias("bv"), F.count(F.lit(1)).alias("n"), F.min("v").alias("v"))
    one = cut(found.select("w", F.when(F.col("nb") == 1, F.col("bv")).when((F.col("nb") == 0) & (F.col("n") == 1), F.col("v")).alias("v")).filter("v is not null"))
    return flat.join(maybe_broadcast(one), "w").groupBy(F.col(key).alias("_key")).agg(F.map_from_entries(F.collect_set(F.struct("w", "v"))).alias("long"))


def spellings(read: DataFrame, key: str, vocabulary: Sequence[str], k: int) -> DataFrame:
    """read with (strict, letters, allowed): what must be equal, the other letters, and how many of these may differ."""
    known = [*GREEK_LETTERS.values(), *vocabulary]
    told = read
    if vocabulary:
        told = read.join(_long_forms(read, key, vocabulary), F.col(key) == F.col("_key"), "left")
        told = told.withColumn("words", F.when(F.col("long").isNull(), F.col("words")).otherwise(F.transform("words", lambda w: F.coalesce(F.try_element_at("long", w), w)))).drop("_key", "long")
    must = lambda w: w.isin(known) | w.rlike(r"^\d+$")
    strict = F.array_join(F.array_sort(F.filter("words", must)), " ")
    rest = F.array_join(F.filter("words", lambda w: ~must(w)), "")
    told = told.withColumn("strict", F.when(F.col("code").isNotNull(), "#").when(F.size("words") > 0, strict).otherwise("="))
    told = told.withColumn("letters", F.when(F.col("code").isNotNull(), F.col("code")).when(F.size("words") > 0, rest).otherwise(F.col("sign")))
    free = F.when(F.length("letters") < 3, 0).when(F.length("letters") < 6, 1).otherwise(k)
    return told.withColumn("allowed", F.when(F.col("strict").isin("#", "="), 0).otherwise(F.least(free, F.lit(k)))).drop("code", "words", "sign")


def pigeonhole_join(inputs: DataFrame, refs: DataFrame, k: int) -> DataFrame:
    """(value, ref, edits) for all pairs with equal strict and letters within the edits that the entry allows (at most k).

    inputs: (value, strict, letters), refs: (ref, strict, letters, allowed). Both sides carry (strict, reference length, edits allowed, segment
    number, segment text) as the equality key.
    """
    cut_at = lambda i: f"cast(floor(n * {i} / (allowed + 1)) as int)"
    segs = F.expr(f"transform(sequence(0, allowed), i -> struct(i as i, substring(letters, {cut_at('i')} + 1, {cut_at('(i + 1)')} - {cut_at('i')}) as seg))")
    named = refs.withColumn("n", F.length("letters"))
    left = named.select("ref", F.col("strict").alias("r_strict"), F.col("letters").alias("r_letters"), F.col("n").alias("r_n"), F.col("allowed").alias("r_allowed"), F.explode(segs).alias("s"))
    left = left.select("ref", "r_strict", "r_letters", "r_n", "r_allowed", F.col("s.i").alias("r_i"), F.col("s.seg").alias("r_seg"))
    # the input may be longer or shorter than the reference by the edits, and the segment may have moved by as much
    # (only lengths that an entry with the same strict part has)
    lengths = left.select(F.col("r_strict").alias("l_strict"), F.col("r_n").alias("n"), F.col("r_allowed").alias("allowed")).distinct()
    grown = inputs.select("value", "strict", "letters").join(maybe_broadcast(lengths), (F.col("strict") == F.col("l_strict")) & (F.abs(F.length("letters") - F.col("n")) <= F.col("allowed")))
    size = f"({cut_at('(i + 1)')} - {cut_at('i')})"
    moved = F.expr(f"""flatten(transform(sequence(0, allowed), i -> transform(filter(sequence({cut_at('i')} + 1 - allowed, {cut_at('i')} + 1 + allowed),
        p -> p >= 1 and p + {size} - 1 <= length(letters)), p -> struct(i as i, substring(letters, p, {size}) as seg))))""")
    probes = grown.withColumn("s", F.explode(F.array_distinct(moved))).select("value", "strict", "letters", "n", "allowed", F.col("s.i").alias("i"), F.col("s.seg").alias("seg"))
    met = probes.join(maybe_broadcast(left), (F.col("strict") == F.col("r_strict")) & (F.col("n") == F.col("r_n")) & (F.col("allowed") == F.col("r_allowed")) & (F.col("i") == F.col("r_i")) & (F.col("seg") == F.col("r_seg")))
    edits = F.levenshtein("letters", "r_letters", k)
    return met.select("value", "ref", edits.alias("edits"), "allowed").filter("edits >= 0 and edits <= allowed").drop("allowed").distinct()


def map_values(inputs: DataFrame, text: str, refs: DataFrame, ref_text: str, k: int = 2, labels: Sequence[str] = (), added: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(matched, unmatched): input rows with `ref` (the entry as written) and `edits`; input rows without one, `why` being 'no entry' or 'tie'.

    Other input columns are kept; ones that are named like these results are replaced. labels and added are words of the caller's field that are written before or into a value and tell nothing ("symbol: x", "x (human)").
    """
    inputs = inputs.drop(*[c for c in ("ref", "edits", "why", "tie", "_value") if c != text])
    # both are read several times below, and bringing a text to its spelling is the costly part
    entries = cut(_read(refs.filter(F.col(ref_text).isNotNull()).select(F.col(ref_text).alias("ref")).distinct(), "ref", labels, added))
    vocabulary = class_words(entries)
    entries = cut(spellings(entries, "ref", vocabulary, k))
    distinct = inputs.select(F.col(text).alias("value")).filter("value is not null").distinct()
    values = cut(spellings(cut(_read(distinct, "value", labels, added)), "value", vocabulary, k).select("value", "strict", "letters").filter("strict <> '' or letters <> ''"))
    # one probe per distinct spelling, then back to the values that share it
    spelt = values.select("strict", "letters").distinct().withColumn("value", F.struct("strict", "letters"))
    near = pigeonhole_join(spelt, entries, k)
    least = near.groupBy("value").agg(F.min(F.struct("edits", "ref")).alias("b"), F.collect_set(F.struct("edits", "ref")).alias("all"))
    told = least.select(F.col("value.strict").alias("n_strict"), F.col("value.letters").alias("n_letters"), "b.ref", "b.edits", (F.size(F.filter("all", lambda x: x["edits"] == F.col("b.edits"))) > 1).alias("tie"))
    found = cut(values.join(told, (F.col("strict") == F.col("n_strict")) & (F.col("letters") == F.col("n_letters"))).select(F.col("value").alias("_value"), "ref", "edits", "tie"))
    matched = inputs.join(found.filter("not tie").drop("tie"), F.col(text) == F.col("_value"), "inner").drop("_value")
    rest = inputs.join(found.filter("not tie").select("_value"), F.col(text) == F.col("_value"), "left_anti")
    ties = found.filter("tie").select("_value")
    unmatched = rest.join(ties, F.col(text) == F.col("_value"), "left").withColumn("why", F.when(F.col("_value").isNotNull(), "tie").otherwise("no entry")).drop("_value")
    return matched, unmatched
