"""Quality rules: a threshold table compiled into one projection.

Each rule bounds one measure of a text.  ``compile_rules`` turns a table of
rules into Columns; the optimizer sees only built-in functions, so the scan, the
measures and the verdict are one stage without a shuffle.

The base rules count the words between spaces in every script, and what fails them is
never kept.  Of the other rules on words, the stop-word rule asks mainly Latin texts
alone, and takes the lists of ``OTHER_STOP_WORDS`` too; texts mainly in scripts without
spaces have no bound on word length, and two of their letters count as a word where
signs are set against words.

Defined results: a NULL or blank text has no words, so it fails the word minimum
and is dropped; repeated rows get the same verdict each; further columns of the
input are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traitlens.llm.common import let, text_or_empty

WORD = r"[^ \t-\r]+"
SYMBOLS = r"[#*$%&|<>]"

# Frequent function words of the languages most often met.
STOP_WORDS = {
    "en": "the of and to in is was for that with it as be by on are this from or an a",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch",
    "fr": "de la le et les des en un du une que est pour qui dans par sur au pas plus avec",
    "es": "de la que el en y a los se del las un por con no una su para es al lo",
}
#: The same for further languages in Latin script; asked only where the first lists find too little.
OTHER_STOP_WORDS = {
    "nl": "het een van en dat niet zijn voor met op te aan ook als maar", "sv": "och att det som är på för inte av till med har ett om var",
    "da": "og at det er på ikke af til med har jeg som et der var", "no": "og at det er på ikke av til med har jeg som et ikkje frå eit",
    "is": "og að er ekki það við til um sem með hann var fyrir", "fy": "it fan yn net dat is wie foar mei hy en op te", "lb": "an de vun den ass net mat dat fir ech si op",
    "af": "nie het is vir van wat met om aan en dat sy", "it": "di che il non per una sono con del della gli anche come", "pt": "que não uma com para os do da em por mais das dos",
    "ro": "și în nu care de la cu este pentru mai din pe sunt", "ca": "que els amb no per una és dels les més com del", "gl": "que non unha do da os as máis por con para unha",
    "oc": "que dels amb per una es lo las son pas dins", "rm": "che ed ils las cun per ina betg ha sin era", "wa": "ki les des po avou nén est dins on ses",
    "pl": "nie się na jest że do to jak ale od przez dla jego", "cs": "se na je že to ale jako jsou by pro který jsem také", "sk": "sa na je že to ale ako sú by pre ktorý som aj",
    "sl": "in je da se na za so ki ne pa bi tudi pri", "hr": "je se na da su za nije kao ali što bi od koji", "lt": "ir yra kad ne su tai buvo iš bet kaip jo apie", "lv": "un ir ka ar nav par no bija kas lai to vai",
    "fi": "ja on ei että se oli hän mutta kun niin ovat myös joka", "et": "ja on ei et see oli ta kui ka mis aga oma", "hu": "az és hogy nem is egy volt ez meg csak de mint már",
    "tr": "ve bir bu için ile da çok ne daha olarak gibi olan kadar", "az": "və bir bu üçün ilə da olan də daha kimi sonra", "uz": "va bu bir uchun bilan ham edi deb esa kerak", "tk": "we bir bu üçin bilen hem bolan diýip şol",
    "ku": "û di ku ji li ew bi ez jî ne ev", "mt": "li ta il fil għal ma minn kien dan hija jew", "sq": "dhe në të për një nuk është me nga që si ka", "eu": "eta da ez bat du dira baina ere izan zen hau",
    "ga": "agus an na ar go is le sé bhí ach do ní", "cy": "yn ac mae ei bod gan oedd wedi ar ond yr", "id": "yang dan di itu dengan untuk ini dari tidak dalam akan pada", "ms": "yang dan di itu dengan untuk ini dari tidak dalam pada ialah",
    "tl": "ang ng sa na mga ay hindi ito para kung at siya", "vi": "và là của không có cho được một người những trong với các", "sw": "na ya wa kwa ni katika za la hii kuwa lakini yake",
}

#: Scripts that put no spaces between words.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}]"


@dataclass(frozen=True)
class Rule:
    """A measure must lie within ``[low, high]``; ``None`` leaves a side open."""

    measure: str
    low: float | None = None
    high: float | None = None
    base: bool = False


#: The base rules decide ``base_failed``; the others add to the verdict.
RULES: tuple[Rule, ...] = (
    Rule("n_words", low=50, base=True),
    Rule("repeat_word_percent", high=50, base=True),
    Rule("mean_word_chars", low=2.5, high=12),
    Rule("symbols_per_word", high=0.1),
    Rule("exclamations_per_word", high=0.3),
    Rule("upper_letter_ratio", high=0.5),
    Rule("duplicate_line_ratio", high=0.4),
    Rule("bullet_line_ratio", high=0.9),
    Rule("ellipsis_line_ratio", high=0.3),
    Rule("stop_word_ratio", low=0.01),
)


def _repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur at least twice in the array.

    Windows are compared by a 64-bit hash.  Only arrays whose windows are not
    all distinct are sorted; equal neighbours then give the covered positions.
    """

    def covered(hashes: Column) -> Column:
        # Equal hashes become neighbours; places of one hash keep their order.
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            again = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | F.coalesce(x["h"] == F.get(s, k + 1)["h"], F.lit(False)))
            return F.sort_array(F.transform(again, lambda x: x["i"]))

        def total(p: Column) -> Column:
            steps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(let(ordered, places), total)

    def counted(w: Column) -> Column:
        hashes = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        )
        return let(
            hashes,
            lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")),
        )

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(counted(words))


def measures(text: Column) -> Column:
    """One struct with counts and ratios of a text; the text is split once."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^ \t-\r]"))
    stop = sorted({w for line in STOP_WORDS.values() for w in line.split()})
    others = sorted({w for line in OTHER_STOP_WORDS.values() for w in line.split()} - set(stop))
    per = lambda n, d: F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))

    def of_parts(p: Column) -> Column:
        w, ls = p["words"], p["lines"]
        n, n_lines = F.size(w).cast("long"), F.size(ls).cast("long")
        stops = F.size(F.filter(w, lambda x: F.lower(x).isin(stop)))
        letters = F.regexp_count(text, F.lit(r"\p{L}"))
        chars = F.length(F.array_join(w, "")).cast("long")
        counts = F.struct(n.alias("n"), n_lines.alias("n_lines"), chars.alias("chars"), letters.alias("letters"), stops.alias("stops"))
        return let(counts, lambda c: let(judged(w, c), lambda e: measured(w, ls, c, e)))

    def judged(w: Column, c: Column) -> Column:
        # Scripts and further lists are looked at only where a rule on words could fail.
        n, letters = c["n"], c["letters"]
        most = lambda pattern: 2 * F.regexp_count(text, F.lit(pattern)) > letters
        unspaced = F.when((n < 50) | (c["chars"] > 12 * n), most(UNSPACED)).otherwise(F.lit(False))
        other = lambda: F.size(F.filter(w, lambda x: F.lower(x).isin(others)))
        known = F.when(100 * c["stops"] >= n, F.lit(False)).when((letters > 0) & ~most(r"\p{IsLatin}"), F.lit(True)).otherwise(100 * other() >= n)
        return F.struct(unspaced.alias("unspaced"), ((n > 0) & known).alias("exempt"))

    def measured(w: Column, ls: Column, c: Column, e: Column) -> Column:
        n, n_lines, letters = c["n"], c["n_lines"], c["letters"]
        symbols = F.regexp_count(text, F.lit(SYMBOLS)).cast("long")
        duplicates = n_lines - F.size(F.array_distinct(ls))
        repeated = _repeated_words(w)
        upper = F.regexp_count(text, F.lit(r"\p{Lu}"))
        units = F.when(e["unspaced"], F.greatest(n, (letters / 2).cast("long"))).otherwise(n)
        return F.struct(
            n.alias("n_words"),
            c["chars"].alias("word_chars"),
            symbols.alias("n_symbols"),
            duplicates.cast("long").alias("n_dup_lines"),
            repeated.alias("n_repeat_words"),
            per(repeated * 100, n).alias("repeat_word_percent"),
            per(c["chars"], n).alias("mean_word_chars"),
            per(symbols, units).alias("symbols_per_word"),
            per(F.length(text) - F.length(F.translate(text, "!", "")), units).alias("exclamations_per_word"),
            per(upper, letters).alias("upper_letter_ratio"),
            per(duplicates, n_lines).alias("duplicate_line_ratio"),
            per(F.size(F.filter(ls, lambda x: x.rlike(r"^\s*[-*•]"))), n_lines).alias("bullet_line_ratio"),
            per(F.size(F.filter(ls, lambda x: x.rlike(r"(\.\.\.|…)\s*$"))), n_lines).alias("ellipsis_line_ratio"),
            per(c["stops"], n).alias("stop_word_ratio"),
            units.alias("n_units"),
            e["unspaced"].alias("unspaced"),
            e["exempt"].alias("stop_words_exempt"),
        )

    return let(F.struct(words.alias("words"), lines.alias("lines")), of_parts)


def broken(rule: Rule, measured: Column) -> Column:
    value, out = measured[rule.measure], F.lit(False)
    if rule.low is not None:
        out = out | (value < rule.low)
    if rule.high is not None:
        out = out | (value > rule.high)
    return out


def failed(rule: Rule, measured: Column) -> Column:
    """Whether the rule is broken, where the text's script and language let it be judged."""
    if rule.measure == "mean_word_chars":
        return broken(rule, measured) & ~measured["unspaced"]
    if rule.measure == "stop_word_ratio":
        return broken(rule, measured) & ~measured["stop_words_exempt"]
    return broken(rule, measured)


def compile_rules(rules: Sequence[Rule], measured: Column) -> dict[str, Column]:
    """``base_failed``, ``kept`` and the names of broken rules as Columns."""
    base, all_broken = F.lit(False), F.lit(False)
    for rule in rules:
        all_broken = all_broken | failed(rule, measured)
        if rule.base:
            base = base | broken(rule, measured)
    names = F.filter(F.array(*[F.when(failed(r, measured), F.lit(r.measure)) for r in rules]), lambda x: x.isNotNull())
    return {"base_failed": base, "kept": ~all_broken, "broken_rules": names}


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per document: its id, all measures, the verdict and the broken rules."""
    text = text_or_empty(text_col)
    measured = docs.select(F.col(id_col).alias("doc_id"), measures(text).alias("m"))
    verdict = compile_rules(rules, F.col("m"))
    return measured.select("doc_id", "m.*", *[c.alias(n) for n, c in verdict.items()])
