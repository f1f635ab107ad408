"""De-identification of text columns: ordered replacement rules, all as Spark functions.

The order of the rules is part of their meaning. A rule whose match must pass a further test (a check digit, a word that
is no name) splits the text at all its matches and joins it again with each match kept or replaced, so no text leaves
the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import staged
from .registry import mark_registry

# ---- Fixed values: patterns, cue words and lists that must equal the published rules. ----

EMAIL = r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b"
URL = r"(?i)\bhttps?://\S+|\bwww\.\S+"
IP = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
LABELLED_ID = (
    r"\b(?i:MRN|NHS|SSN|NIC|National ID|ID|Patient ID|Record|Hospital No|Passport)\.?\s*"
    r"(?:(?i:no|number|is)\.?\s*|#\s*|:\s*)?"
    r"(?:[A-Z]{1,4}[- ]?)?\d[\d -]{2,14}\d(?:[- ]?[A-Z]{1,4}\b)?"
)
IDENTITY_CARD = r"\b\d{9}[VvXx]\b|\b(?:19|20)\d{2}[0-8]\d{7}\b"
PASSPORT = r"\b(?i:passport)(?:\s+(?i:no|number))?\.?\s*[:#]?\s*[A-Z]{1,2}\d{6,8}\b"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
CARD = r"\b(?:\d[ -]?){12,15}\d\b"
MONTH_SHORT = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"
DATE_NUMERIC = r"\b\d{1,2}[/.-]\d{1,2}[/.-](?:19|20)\d{2}\b|\b(?:19|20)\d{2}[-/.]\d{1,2}[-/.]\d{1,2}\b"
DATE_DAY_FIRST = rf"\b\d{{1,2}}(?:st|nd|rd|th)?\s+(?:of\s+)?(?:{MONTH_SHORT})[a-z]*\.?,?\s+(?:19|20)\d{{2}}\b"
DATE_MONTH_FIRST = rf"\b(?:{MONTH_SHORT})[a-z]*\.?\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+(?:19|20)\d{{2}}\b"
AGE = r"\b(?:9\d|1[0-1]\d)(?:[- ](?:year|yr)s?[- ]old|[- ]?(?:yo|y/o|y\.o\.)\b)|\b(?i:aged|age)\s+(?:9\d|1[0-1]\d)\b"
ADDRESS = (
    r"\b\d{1,5}[A-Z]?(?:/\d{1,4})?,?\s+(?:[A-Z][a-z]+\s+){1,3}"
    r"(?:Street|St\.|Road|Rd\.?|Lane|Avenue|Ave\.?|Mawatha|Place|Drive|Terrace|Close|Crescent|Gardens|Boulevard)\b"
    r"(?:,?\s+[A-Z][a-z]+(?:\s+\d{3,6})?)?"
)
PHONE = r"(?<![\w-])(?:\+?\d{1,3}[-.\s]?)?\(?\d{2,4}\)?[-.\s]\d{3,4}[-.\s]?\d{3,4}\b"
PHONE_WIDE = r"\b(?:\+?\d{1,3}[-.\s]?)?\(?\d{2,4}\)?[-.\s]?\d{3,4}[-.\s]?\d{3,4}\b"

NAME = r"[A-Z](?:'[A-Z])?[a-z]+(?:[A-Z][a-z]+)?(?:-[A-Z][a-z]+)?"
FULL_NAME = rf"{NAME}(?:\s+{NAME}){{0,2}}(?:\s+\d{{1,4}})?"
#: Each cue pattern has what stays before a name, the name, and what stays after it.
NAME_CUES = [
    rf"(\b(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Professor|Nurse|Patient|Pt)\.?\s+)({FULL_NAME})()",
    rf"(\b(?:[Mm]y name is|[Nn]ame:|[Pp]atient named|[Pp]atient|[Ii] am)\s+)({FULL_NAME})()",
    rf"(\b(?:[Dd]aughter|[Ss]on|[Ww]ife|[Hh]usband|[Mm]other|[Ff]ather|[Bb]rother|[Ss]ister|[Pp]artner|[Ss]pouse|[Gg]uardian|[Cc]arer|[Cc]aregiver|[Nn]ext of kin)[,:]?\s+)({FULL_NAME})()",
]
NOT_NAMES = """The This A An He She They Was Is With Who In On At History Presented Admitted Discharged Aged Male Female
Diagnosed Health Survey Population Questionnaire Reported Outcome Outcomes Care Safety Education Satisfaction Experience
Experiences Practitioner Practitioners Protection Preference Preferences Centered Centred Assessment Registry Records Record
Information Advocacy Engagement Journey Portal""".split()

MONTH = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
MONTHS = "January February March April May June July August September October November December".split()
LABELLED_NUMBER = (
    r"\b(?i:account|acct|a/c|billing|policy|member(?:ship)?|insurance|insurer|health plan|beneficiary|subscriber|"
    r"claim|driving licen[cs]e|licen[cs]e|certificate|registration|number plate|licen[cs]e plate|plate|VIN|chassis|"
    r"serial|S/N|IMEI|badge|employee|staff|"
    r"medical record|health record|record|chart|case file|file|identity card|ID card|national identity card|UHID)"
    r"(?:\s+(?i:no|number|num|id|code|#)\.?){0,2}\s*(?:[:#]\s*)?"
    r"(?=[A-Z0-9/ -]{0,30}?\d[A-Z0-9/ -]{0,30}?\d[A-Z0-9/ -]{0,30}?\d)"
    r"[A-Z0-9](?:[A-Z0-9/-]|\s(?=[A-Z0-9]))*[A-Z0-9]"
)
FAX = r"\b(?i:fax)\.?\s*(?i:no|number)?\.?\s*:?\s*\+?[\d()][\d ()-]{6,18}\d"
PARTIAL_DATES = [
    r"(?<![\d.])\d{1,2}([/.-])\d{1,2}\1\d{2}(?![\d.]\d|\d)",
    rf"\b\d{{1,2}}(?:st|nd|rd|th)?\s+(?:of\s+)?{MONTH}\b",
    rf"\b{MONTH}\.?\s+\d{{1,2}}(?:st|nd|rd|th)?\b(?!\s*(?:%|mg|patients|cases))",
    r"\b(?i:on|dated)\s+\d{1,2}/\d{1,2}\b(?![/.]\d|\s*(?:mg|mmHg|%))",
]
MONTH_YEAR = rf"\b{MONTH}\.?,?\s+((?:19|20)\d{{2}})\b"
INSTITUTION = (
    r"\b(?!(?:The|Our|A|An|This|That|Its|Their|His|Her|In|At|To|From|Of|Each|Every)\s)"
    r"(?:St\.?\s+|Saint\s+)?(?:[A-Z][a-z']+\s+){1,4}"
    r"(?:Hospital|Medical Cent(?:er|re)|Clinic|Infirmary|Health Cent(?:er|re)|Nursing Home|Hospice|Polyclinic)\b"
)
POSTCODES = [
    r"\b[A-Z]{1,2}\d[A-Z\d]?\s\d[A-Z]{2}\b",
    r"\b[A-Z]{2}\s\d{5}(?:-\d{4})?\b",
    r"\b(?i:zip(?: code)?|postcode|post code|postal code)\s*:?\s*[A-Z0-9]{3,4}\s?[A-Z0-9]{0,4}\b",
]
PLACE_CUES = [
    r"(\b(?:[Rr]esident of|[Rr]esides in|[Rr]esiding in|[Ll]ives in|[Ll]iving in|[Ll]ived in|[Bb]orn in|[Nn]ative of|"
    r"[Hh]ometown(?: of| is|,)?|from the (?:town|village|city|district|province) of|[Hh]ome in|"
    r"(?:travell?ed|came|moved|relocated) (?:here )?(?:from|to))\s+)((?:[A-Z][a-z]+)(?:[ -][A-Z][a-z]+){0,2})()",
    r"(\bin )([A-Z][a-z]+(?: [A-Z][a-z]+)?)(, (?:[A-Z][a-z]+(?: [A-Z][a-z]+)?|[A-Z]{2})\b)",
]
PERSON_NEXT = (
    r"(?=,\s+an?\s+\d{1,3}[- ](?:year|month|week|day)|\s+\(\d{1,3}\s*(?:y|yo|yrs?|years?)\b|"
    r"\s+(?:was|is|had|has)\s+(?:admitted|referred|brought|transferred|seen|born|discharged|a\s+\d)|"
    r"\s+(?:presented|complained|reported|underwent|died|attended|visited|consented)\b|"
    r"'s\s+(?:mother|father|wife|husband|daughter|son|family|parents|sister|brother|condition|symptoms))"
)
UNTITLED_NAMES = [
    rf"(\b)({NAME}\s+{NAME}(?:\s+{NAME})?)({PERSON_NEXT})",
    rf"(\b(?:[Aa]ttending|[Cc]onsultant|[Ss]urgeon|[Pp]hysician|[Rr]eferred by|[Ss]een by|[Ss]igned(?: by)?:?|[Rr]eviewed by|[Cc]c:)\s+(?:Dr\.?\s+)?)({FULL_NAME})()",
    r"(\b)([A-Z]\.\s?(?:[A-Z]\.\s?)?[A-Z][a-z]+)(,?\s+(?=(?:MD|MBBS|DO|RN|FRCP|MRCP|MS|PhD)\b))",
    rf"(\b(?:[Cc]onsent|[Pp]ermission|[Aa]ssent)\b[^.]{{0,40}}?\b(?:from|by)\s+)({FULL_NAME})()",
    r"(\b(?:NAME|PATIENT|PT NAME|PATIENT NAME|[Nn]ame|[Pp]atient|[Pp]atient [Nn]ame)\s*:\s*)([A-Z][A-Za-z'-]+,?\s+[A-Z][A-Za-z'-]+(?:\s+[A-Z][A-Za-z'-]+)?)()",
    rf"(\b(?:[Tt]he|[Oo]ur|[Aa]|[Tt]his)\s+(?:patient|man|woman|boy|girl|mother|father|husband|wife|son|daughter|infant|child|proband|gentleman|lady),\s+)({FULL_NAME})(,)",
    rf"(\[NAME\],\s+)({NAME})(\b(?!\s+[a-z]))",
]
NOT_EPONYM = (
    r"(?![-'’]|\s*\d|\s+(?:disease|syndrome|sign|signs|test|score|criteria|classification|scale|"
    r"type|stage|grade|lymphoma|sarcoma|tumou?r|procedure|operation|method|technique|stain|staining|"
    r"reaction|phenomenon|cells?|nodes?|fracture|ulcer|palsy|dystrophy|anomaly|malformation|catheter|"
    r"tube|mano?euvre|maneuver|approach|incision|flap|repair|index|formula|equation|curves?|analysis|"
    r"correction|coefficient|virus|agar|medium|solution|tablets?|capsules?|injection|spp|sp|proteins?|bodies|body|"
    r"male|female|man|woman|men|women|boy|girl|patient|patients|descent|origin|ancestry|heritage|"
    r"birth|diet|population|child|children|infant|adult|lady|gentleman|family|nationals?|"
    r"[a-z]+(?:us|um|is|ae|ii|i|a)\b))"
)
UNCOMMON_PAIR = rf"(\b)({NAME}\s+{NAME})(\b{NOT_EPONYM})"
UNCOMMON_PLACE = rf"(\b(?:from|in|at|near)\s+)([A-Z][a-z]{{2,}}(?:\s[A-Z][a-z]{{2,}})?)(\b{NOT_EPONYM})"
NOT_NAME_WORDS = """Patient Patients Case Cases Our Their His Her Its Physical Clinical Report Emergency Department Hospital
Medical Center Centre University General Type Group Table Figure Fig Disease Syndrome Doctor Mother Father Baby Infant Boy
Girl Man Woman Subject Proband Index Control Controls Twin Donor Figs Figures Tables Supplementary Appendix Video
Panel""".split()
LABELS = ["REGISTRY", "EMAIL", "URL", "IP", "ID", "SSN", "CARD", "DATE", "AGE", "ADDRESS", "PHONE", "NAME", "LOCATION", "ORGANIZATION"]
PLACEHOLDERS = r"\[(?:EMAIL|URL|IP|ID|SSN|CARD|DATE|PHONE|NAME|NAME_OR_ID|LOCATION|AGE|ADDRESS|ORGANIZATION)\]"

# ---- End of fixed values. ----

#: The rules of the basic level before names, in order.
STRUCTURED = [
    ("EMAIL", EMAIL), ("URL", URL), ("IP", IP), ("ID", LABELLED_ID), ("ID", IDENTITY_CARD), ("ID", PASSPORT), ("SSN", SSN), ("CARD", CARD),
    ("DATE", DATE_NUMERIC), ("DATE", DATE_DAY_FIRST), ("DATE", DATE_MONTH_FIRST), ("AGE", AGE), ("ADDRESS", ADDRESS), ("PHONE", PHONE),
]


def unicode(pattern: str) -> str:
    """The pattern with word characters, digits, blanks and boundaries of all scripts."""
    return f"(?U){pattern}"


#: What any match of a rule must contain; texts without it are passed over before the rule's own pattern is tried.
DIGIT, AT, LINK = r"(?U)\d", "@", r"(?i)http|www"
#: A character that stands for a match while its text is rebuilt; texts that hold it take the longer way.
CUT = "\x01"


@dataclass
class Rule:
    """Matches of a pattern become the mark; with a test, only those whose second group passes, and groups 1 and 3 stay.

    The three groups of a tested pattern make up the whole match. needs is a short pattern that every match contains.
    """

    label: str
    pattern: str
    mark: str
    test: Callable[[Column], Column] | None = None
    needs: str | None = None

    def matches(self, text: Column, group: int) -> Column:
        return F.regexp_extract_all(text, F.lit(unicode(self.pattern)), F.lit(group))

    def count(self, text: Column) -> Column:
        if self.test is None:
            return F.regexp_count(text, F.lit(unicode(self.pattern)))
        return F.size(F.filter(self.matches(text, 2), self.test))

    def _pieces(self, text: Column) -> Column:
        """Text between the matches and matches in turn, these as their three groups."""
        groups = F.regexp_replace(text, unicode(self.pattern), f"{CUT}$1{CUT}$2{CUT}$3{CUT}")
        return F.split(groups, CUT, -1)

    def cut(self, text: Column) -> Column:
        """The text with each replaced match as CUT and its mark: one search gives the text and the count."""
        if self.test is None:
            return F.regexp_replace(text, unicode(self.pattern), CUT + self.mark)

        # pieces are text, group 1, group 2, group 3, text, ...
        def put(x: Column, i: Column) -> Column:
            return F.when((i % 4 == 2) & self.test(x), F.lit(CUT + self.mark)).otherwise(x)

        return F.array_join(F.transform(self._pieces(text), put), "")

    def apply(self, text: Column) -> Column:
        if self.test is None:
            return F.regexp_replace(text, unicode(self.pattern), self.mark)
        return F.when(F.contains(text, F.lit(CUT)), self._long_way(text)).otherwise(F.replace(self.cut(text), F.lit(CUT), F.lit("")))

    def _long_way(self, text: Column) -> Column:
        p = unicode(self.pattern)
        if self.test is None:
            return self.apply(text)
        found = F.arrays_zip(*(self.matches(text, g).alias(n) for g, n in enumerate(("m", "a", "name", "z"))))
        put = F.transform(found, lambda x: F.when(self.test(x["name"]), F.concat(x["a"], F.lit(self.mark), x["z"])).otherwise(x["m"]))
        around = F.zip_with(F.split(text, p, -1), F.concat(put, F.array(F.lit(""))), lambda t, m: F.concat(t, m))
        return F.when(text.rlike(p), F.array_join(around, "")).otherwise(text)


def luhn(number: Column) -> Column:
    """Whether the check digit of a number holds; characters other than digits don't count."""
    digits = F.reverse(F.filter(F.split(number, ""), lambda c: c.rlike("^[0-9]$")))
    value = F.transform(digits, lambda c, k: c.cast("int") * (1 + k % 2))
    return F.aggregate(value, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def _words(name: Column) -> Column:
    return F.filter(F.split(name, r"\s+"), lambda w: w != "")


def _listed(words: list[str]) -> Callable[[Column], Column]:
    return lambda w: w.isin(words)


def first_word_is_a_name(name: Column) -> Column:
    return ~_listed(NOT_NAMES)(F.element_at(_words(name), 1))


def first_word_is_a_place(name: Column) -> Column:
    return ~_listed([*MONTHS, *NOT_NAMES])(F.element_at(_words(name), 1))


def no_word_is_ordinary(name: Column) -> Column:
    """No word of more than one letter is a month or a word that is no name."""
    bare = F.transform(_words(name), lambda w: F.btrim(w, F.lit(",.")))
    return ~F.exists(bare, lambda w: (F.length(w) > 1) & _listed([*NOT_NAMES, *MONTHS, *NOT_NAME_WORDS])(w))


def all_uncommon(proper: Column) -> Callable[[Column], Column]:
    """Whether all words are among the text's proper nouns (lower case) and none is a word that is no name."""
    return lambda name: F.forall(_words(name), lambda w: F.array_contains(proper, F.lower(w)) & ~_listed([*NOT_NAMES, *MONTHS, *NOT_NAME_WORDS])(w))


def registry_pattern(names: list[str]) -> str | None:
    """Known names and ids in all their forms (fixed values), longest first, as whole words in any case: for short lists."""
    forms = {n.strip() for n in names if n and n.strip()}
    for name in sorted(forms):
        *first, last = name.split()
        if first and all(p[0].isalpha() for p in [*first, last]):
            given = " ".join(first)
            forms |= {f"{last}, {given}", f"{last} {given}", f"{given[0]}. {last}", f"{given[0]} {last}"}
    return r"(?i)\b(?:" + "|".join(re.escape(f) for f in sorted(forms, key=lambda f: (-len(f), f))) + r")\b" if forms else None


def basic_rules(registry: list[str] = (), id_patterns: list[str] = (), safe_harbor: bool = False) -> list[Rule]:
    """The rules up to the cued names, in order."""
    known = registry_pattern(list(registry))
    rules = [Rule("REGISTRY", known, "[NAME_OR_ID]")] if known else []
    rules += [Rule("ID", p, "[ID]") for p in id_patterns]
    if safe_harbor:
        rules += [Rule("PHONE", FAX, "[PHONE]", needs=DIGIT), Rule("ID", LABELLED_NUMBER, "[ID]", needs=DIGIT)]
    for label, pattern in STRUCTURED:
        if safe_harbor and label == "AGE":
            rules += [Rule("DATE", p, "[DATE]", needs=DIGIT) for p in PARTIAL_DATES] + [Rule("DATE", MONTH_YEAR, "[DATE] $1", needs=DIGIT)]
        needs = {"EMAIL": AT, "URL": LINK}.get(label, DIGIT)
        rules.append(Rule("CARD", f"()({CARD})()", "[CARD]", luhn, needs) if label == "CARD" else Rule(label, pattern, f"[{label}]", needs=needs))
    if safe_harbor:
        rules += [Rule("ORGANIZATION", INSTITUTION, "[ORGANIZATION]"), *(Rule("LOCATION", p, "[LOCATION]") for p in POSTCODES)]
        rules += [Rule("LOCATION", p, "[LOCATION]", first_word_is_a_place) for p in PLACE_CUES]
    rules += [Rule("NAME", p, "[NAME]", first_word_is_a_name) for p in NAME_CUES]
    if safe_harbor:
        rules += [Rule("NAME", p, "[NAME]", no_word_is_ordinary) for p in UNTITLED_NAMES]
    return rules


def apply_rules(df: DataFrame, rules: list[Rule], text_col: str = "text", counted: bool = False) -> DataFrame:
    """df with its text replaced, rule after rule, each a projection of its own so that none is computed twice.

    counted adds n_<label> columns, or raises those that are there. What rules need is looked for once, in the text as it
    comes: no mark contains any of it. Most texts lack it, and then the rule's own pattern is never tried.
    """
    taken = [c.lower() for c in df.columns]
    free = "rule_" + "_" * sum(c.startswith("rule_") for c in taken)
    needs = {n: f"{free}{k}" for k, n in enumerate(dict.fromkeys(r.needs for r in rules if r.needs))}
    flags, after = {**needs, "": f"{free}cut"}, f"{free}after"
    df = df.withColumns({flags[""]: F.contains(text_col, F.lit(CUT)), **{c: F.contains(text_col, F.lit(n)) if n == AT else F.col(text_col).rlike(n) for n, c in needs.items()}})
    for rule in rules:
        text, name = F.col(text_col), f"n_{rule.label.lower()}"
        may = F.col(needs[rule.needs]) if rule.needs else F.lit(True)
        if not counted:
            df = df.withColumn(text_col, F.when(may, rule.apply(text)).otherwise(text))
            continue
        odd = F.col(flags[""])
        df = df.withColumn(after, F.when(may, F.when(odd, rule._long_way(text)).otherwise(rule.cut(text))).otherwise(text))
        clean = F.replace(F.col(after), F.lit(CUT), F.lit(""))
        n = F.when(text.isNull() | ~may | (F.col(after) == text), F.lit(0)).when(odd, rule.count(text)).otherwise(F.char_length(after) - F.char_length(clean))
        df = df.withColumn(name, n + (F.col(name) if name in df.columns else F.lit(0)))
        df = df.withColumn(text_col, F.when(odd, F.col(after)).otherwise(clean)).drop(after)
    return df.drop(*flags.values())


def deidentify(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: str = "basic", registry: list[str] | DataFrame = (), id_patterns: list[str] = (), common: DataFrame | None = None,
    counted: bool = False, recogniser: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """df with identifiers in its text replaced by marks; other columns stay, null texts stay null.

    level safe_harbor adds labelled numbers, partial dates, institutions, places and untitled names. With common (a table
    of words that writers use in lower case, one column word) it also replaces pairs of capitalised words and places
    none of whose words is common: the texts' capitalised words meet the table in a join, so the dictionary may be of any
    size. id_col must tell rows apart for that step, before which the texts are staged: the rules run once. A recogniser (a table to a table) runs first at level basic,
    before the cued names at safe_harbor. A match that fails its rule's test is passed over whole. registry is a short list
    of known names and ids, or a table of any size (one column name), whose rows meet the texts' words in joins.
    """
    if level not in ("basic", "safe_harbor"):
        raise ValueError(f"unknown level: {level}")
    sh = level == "safe_harbor"
    if counted:
        df = df.withColumns({f"n_{x.lower()}": F.lit(0) for x in LABELS})
    listed = registry if not isinstance(registry, DataFrame) else ()
    rules = basic_rules(listed, id_patterns, sh)
    names = next(k for k, r in enumerate(rules) if r.label == "NAME")
    if recogniser is not None and not sh:
        df = recogniser(df)
    if isinstance(registry, DataFrame):
        df = mark_registry(df, registry, id_col, text_col, count_col="n_registry" if counted else None)
    df = apply_rules(df, rules[:names], text_col, counted)
    if recogniser is not None and sh:
        df = recogniser(df)
    df = apply_rules(df, rules[names:], text_col, counted)
    if not sh or common is None:
        return df
    df = staged(df)
    proper = "proper_nouns_" + "_" * sum(c.startswith("proper_nouns") for c in df.columns)
    found = F.concat(*(F.flatten(F.transform(F.regexp_extract_all(text_col, F.lit(unicode(p)), F.lit(2)), _words)) for p in (UNCOMMON_PAIR, UNCOMMON_PLACE)))
    words = df.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(F.transform(found, F.lower))).alias("word"))
    rare = words.join(common.select("word").distinct(), "word", "left_anti").groupBy("id").agg(F.collect_set("word").alias(proper))
    joined = df.join(rare.withColumnRenamed("id", f"{proper}id"), F.col(id_col) == F.col(f"{proper}id"), "left").drop(f"{proper}id")
    test = all_uncommon(F.coalesce(proper, F.array().cast("array<string>")))
    last = [Rule("NAME", UNCOMMON_PAIR, "[NAME]", test), Rule("LOCATION", UNCOMMON_PLACE, "[LOCATION]", test)]
    return apply_rules(joined, last, text_col, counted).select(df.columns)


def redact_pii(text: Column) -> Column:
    """E-mail addresses, social security numbers and phone numbers, before texts are embedded or described."""
    for pattern, mark in ((EMAIL, "[REDACTED_EMAIL]"), (SSN, "[REDACTED_ID]"), (PHONE_WIDE, "[REDACTED_PHONE]")):
        text = F.regexp_replace(text, unicode(pattern), mark)
    return text


def strip_placeholders(text: Column) -> Column:
    """Marks become blanks, so that none turns into a topic."""
    return F.regexp_replace(text, PLACEHOLDERS, " ")
