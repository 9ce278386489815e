"""Personal information inside free text: finding it, and replacing it by typed, format-preserving pseudonyms.

Mentions are found by kind: telephone numbers, mail addresses (also disguised ones), street addresses (house number with
street, post boxes, rural routes), identity numbers (behind a word that says what they are, or nine digits written in their
form), birth dates (behind a word that says so; other dates are no mentions) and names. A name is a family name behind a title,
or two or three words of which the first is a known given name, or any such words, with capitals in a text that has case, behind
a word that says a person follows ("my wife", "spoke with", "owner:", "sincerely") or before what only persons do ("told me");
in a text without case only an outright cue counts ("my name is"). Values are validated: a telephone number has an area code, a
social security number no part of zeros, a date is one; names of roads, firms, offices, places and vehicles are told from persons
by their words and by what follows. Names without cue, title or known given name are not found.

Each mention is replaced by ``[KIND value]``, the value by the keyed permutations of ``pseudonyms``: numbers, their letters and
dates stay in their format and linked across documents, words become a keyed code.

Defined results: null text has no mentions and stays null; empty text stays empty; mentions never overlap (mail addresses
go before numbers, numbers before addresses, addresses before names); ``[XXX]`` is left alone; positions count characters from
1 in the untouched text; the text is searched whole, whatever its length.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.pseudonyms import code, permute_date, permute_valid, permute_within, read_date
from caseloom.session import spread

NAME, PHONE, EMAIL, ADDRESS, IDENTITY, BIRTH_DATE = "name", "phone", "email", "street_address", "id_number", "birth_date"
MENTION_SCHEMA = "array<struct<kind: string, start_pos: int, stop_pos: int, placeholder: string>>"

# Some given names in use, everyday words among them. A name in the list needs no cue before it; any other name does.
GIVEN_NAMES = (
    "aaron adam ahmed aisha alan albert alejandro alex alexander alice amanda amy ana ana-maría ana-maria andrea andrew angela ann anna anthony "
    "antonio arthur ashley barbara benjamin beth betty brandon brenda brian carl carlos carol carolyn catherine charles chase cheryl "
    "christina christine christopher curtis cynthia dale daniel david deborah debra denise dennis diana diane dmitri donald donna dorothy douglas edward elena "
    "elizabeth emily emma eric ethan eugene evelyn faith fatima frances gary george gerald gloria grace grant gregory hannah harold heather "
    "helen henry hiro inés ines ivan ivy jacob jacqueline james janet janice jason jeffrey jennifer jeremy jerry jessica joan johnny john jonathan jose josé "
    "joseph joshua joyce juan judith judy julia julie justin karen katherine kathleen keith kelly kenneth kevin kimberly kyle larry laura latoya lauren "
    "lawrence linda lisa luis margaret maria maría marie marilyn mark martha mary matthew megan melissa michael michelle mohammed monica nancy "
    "natalie nicholas nicole noah olga olivia omar pamela patricia patrick paul peter philip priya rachel ralph raymond rebecca richard robert roger ronald rose "
    "russell ruth ryan samantha samuel sandra sara sarah scott sergei sharon shirley sophia stephanie stephen steven susan teresa terry theresa "
    "thomas timothy tyler victoria vincent virginia walter wayne wei william yolanda yusuf zoe zoë"
)

# Street words, and words behind which no family name stands.
STREET_WORDS = (
    "street st road rd avenue ave boulevard blvd drive dr lane ln court ct way parkway pkwy terrace ter circle cir trail trl place pl highway hwy square sq "
    "loop alley crescent cres path row run pike turnpike expressway"
)
STREETS_BEFORE = "avenida calle camino paseo via rue"
FIRM_WORDS = (
    "motors motor auto autos automotive garage tires tire service services center centre group shop body brothers bros sons company co corp corporation inc llc ltd dealer "
    "dealership toyota ford works repair collision towing county city town hill mill falls springs heights plaza mall school church bank hospital clinic "
    "apt apartment suite ste unit exit box"
)
COMMON_WORDS = (
    "a about after again all also am an and any are as asked at back be because been before behind being but by call called came can could did do does drove "
    "for from gave get got had has have he her him his how i if in into is it its just last left like me mr mrs ms my near need new no not now of off on or our out over "
    "owns please recall said saw says she since so soon spoke still than thank thanks that the their them then there they this to told too took towed until up us was we went were what when "
    "where which while who will with without would write yes you your told tried two stored happened home mail best number phone cell tel ph contact reach photos sent reference owner registered "
    "license passport ssn dl invoice works lives reported complained stated drives drove fixed knows wrote answered hung phoned emailed sister husband wife father mother friend neighbor"
)

_WORD = r"[^\W\d_]"
_EMAIL = re.compile(
    r"(?<![\w.+%'-])[A-Za-z0-9][\w.+%'-]*(?:\s?@\s?|\s?[(\[{]\s?at\s?[)\]}]\s?|\sat\s(?=[A-Za-z0-9-]+(?:\s?[(\[{]\s?dot|\sdot\s)))"
    r"[A-Za-z0-9-]+(?:(?:\.|\s?[(\[{]\s?dot\s?[)\]}]\s?|\sdot\s)[A-Za-z0-9-]+)+",
    re.I,
)
_WORDS = re.compile(r"[^\W\d_]+")
_DIGIT = re.compile(r"\d")
_LINE_NUMBER = re.compile(r"\d{3}[-. ]?\d{4}(?!\w)")
_PHONE = re.compile(r"(?<![\w-])(?<![\d][./-])(?:\+?\d{1,2}[-. ]?)?(?:\(\d{3}\)\s?|\d{3}[-. /]?)\d{3}[-. ]?\d{4}(?![\w]|-\d)")
_ID_CUE = re.compile(
    r"(?P<ssn>\bs\.?s\.?n\b|\bsoc(?:ial)?\.?\s*sec(?:urity)?\b|\bmy\s+social\b|\bsocial\s+insurance\b)"
    r"|(?P<dl>\bd\.?l\.?(?=\s*(?:#|no\b|num|:|[A-Za-z]\d))|\bdriver'?’?s?'?’?\s*licen[cs]es?\b|\blicen[cs]e\s+(?:number|no\.?)\s*\(driver\)|\bdriving\s+licen[cs]e\b)"
    r"|(?P<pp>\bpassport\b)",
    re.I,
)
_ID_GAP = r"(?:[\s:#.,()=-]|\b(?:no|num|number|nr|is|was|which|it|driver|the|my|of|card)\b){0,12}"
_ID_VALUE = {
    "ssn": re.compile(_ID_GAP + r"(?P<v>\d{3}[-. ]?\d{2}[-. ]?\d{4})(?!\d)", re.I),
    "dl": re.compile(_ID_GAP + r"(?P<v>[A-Za-z]{1,2}[- ]?\d{3}[- ]\d{4}[- ]\d{4}|[A-Za-z]{1,2}\d{6,13}|\d{7,12})(?!\w)", re.I),
    "pp": re.compile(_ID_GAP + r"(?P<v>[A-Za-z]{1,2}\d{6,9}|\d{9})(?!\w)", re.I),
}
_BARE_SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
_STREET = "|".join(sorted(STREET_WORDS.split(), key=len, reverse=True))
_HOUSE = r"(?<![\w.,$#/-])\d{1,6}(?:[A-Za-z](?![A-Za-z])|\s?-\s?[A-Za-z](?!\w)|\s?½|\s1/2)?"
_ADDRESS = re.compile(
    _HOUSE + r"\s+(?:"
    + r"(?P<pre>(?:(?:n|s|e|w|ne|nw|se|sw|north|south|east|west)\.?\s+)?)(?P<mid>(?:(?:st\.\s+|" + _WORD + r"[\w'’-]*\s+|\d{1,3}(?:st|nd|rd|th)\s+){1,3}?))(?P<suf>" + _STREET + r")(?!\w)"
    + r"|(?:" + "|".join(STREETS_BEFORE.split()) + r")\s+(?:de\s+la\s+|del\s+|de\s+|los\s+|las\s+)?" + _WORD + r"+)",
    re.I,
)
_BOX = re.compile(r"\b(?:p\.?\s?o\.?\s?box|post\s+office\s+box)\s+#?\d+|\b(?:rural\s+route|r\.?\s?r\.?|hc|highway\s+contract)\s*#?\d+,?\s+box\s+\d+[a-z]?\b", re.I)
_NAME_WORD = r"(?:[OoDd]['’`])?" + _WORD + r"{2,}(?:['’`]" + _WORD + r"+)?(?:-(?:[OoDd]['’`])?" + _WORD + r"+)*"
_TOKEN = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_AFTER_GIVEN = re.compile(r"\s+(?:(?P<mid>" + _WORD + r")\.?\s+)?(?P<fam>" + _NAME_WORD + r")")
_BEFORE_GIVEN = re.compile(r"(?P<fam>" + _NAME_WORD + r")\s*,\s*$")
_TITLE = re.compile(r"\b(?P<t>mr|mrs|ms|dr|miss|prof|sir|madam)\b\.?\s+(?P<fam>" + _NAME_WORD + r")", re.I)
_TITLE_BEFORE = re.compile(r"(?:^|[,:;(\n*!?-]|\b(?:for|to|called|with|by|from|and|told|saw|asked|named|is|was|doctor|adviser|advisor|manager|mechanic|owner|or|that|when|the|a|of|met))\s*$", re.I)
_OWNER_CUE = re.compile(r"(?:owner|name|customer|client|driver|registered to|signed)\s*[:,-]?\s*$", re.I)

_AT = re.compile(r"[(\[{]\s?at\s?[)\]}]")
_BIRTH = re.compile(r"(?:\bd\.?o\.?b\b|\bdate\s+of\s+birth\b|\bbirth\s?dat?[ey]\w*\b|\bborn\b)[\s:#.,()=-]*(?:is\s+|was\s+|on\s+){0,2}(?P<v>\d{1,4}[/.-]\d{1,2}[/.-]\d{2,4}|[A-Za-z]{3,9}\.?\s+\d{1,2}(?:st|nd|rd|th)?,?\s+\d{4})(?!\w)", re.I)
# What makes the words behind it, or before it, a person; a deployment adds its own.
RELATIONS = "wife husband son daughter mother father mom dad sister brother cousin aunt uncle nephew niece grandson granddaughter grandmother grandfather fiance fiancee girlfriend boyfriend friend neighbor neighbour roommate colleague coworker boss partner"
ROLES = "owner co-owner driver passenger customer client buyer seller adviser advisor manager mechanic technician salesman saleswoman salesperson representative rep agent attorney lawyer officer trooper deputy doctor nurse witness investigator engineer receptionist supervisor operator"
PERSON_ACTS = "said says told stated called wrote answered promised refused claimed explained phoned emailed replied confirmed hung laughed insisted admitted assured apologized who"
_ROLE = "(?:" + "|".join([*RELATIONS.split(), *ROLES.split()]) + ")"
_FULL_NAME = r"(?P<given>" + _NAME_WORD + r")(?:\s+(?:" + _WORD + r"\.?|(?P<more>" + _NAME_WORD + r")))?\s+(?P<fam>" + _NAME_WORD + r")(?![\w'’]*\w)"
_CAPITALS = re.compile(r"(?<![\w'’-])" + _FULL_NAME.replace("(?P<", "(?=[^\\W\\d_a-z])(?P<"))
_PERSON_BEFORE = re.compile(
    r"(?<!\w)(?:(?:full\s+)?names?\s*(?:is|was|:|-)|i\s+am|i['’]m|this\s+is|(?:spoke|spoken|speaking|talked|talking|met|dealt|dealing|wrote|written|writing)\s+(?:with|to)|(?:ask|asked|asking)(?:\s+for)?"
    r"|contact|call|reach|e-?mail|text|page|contacted|called|told|emailed|registered\s+(?:to|under)|titled\s+(?:to|in)|sold\s+(?:it\s+)?to|belongs\s+to|owned\s+by|signed(?:\s+by)?|sincerely|regards|attn\.?|attention|c/o|reported\s+by|filed\s+by|on\s+behalf\s+of"
    r"|" + _ROLE + r"(?:\s+(?:is|was|named|called))?)\s*[,:;-]?\s+$",
    re.I,
)
_ACTS = r"\s+(?:" + "|".join(PERSON_ACTS.split()) + r")\b"
_PERSON_AFTER = re.compile(r",?" + _ACTS + r"|\s+(?:at|from|in)\s+(?:the|that|their)\s+(?:dealer|dealership|service|shop|garage|parts)\b|\s+(?:or|and)\s+[^\W\d_a-z]\w+\s+[^\W\d_a-z]\w+" + _ACTS)
_NAMED_OUTRIGHT = re.compile(r"\b(?i:(?:my|his|her)\s+(?:full\s+)?name\s+(?:is|was)|owner(?:'s)?\s+name\s*(?:is|was|:|-)|name\s*:|registered\s+(?:to|under)\s+(?:the\s+name\s+)?|signed(?:\s+by)?\s*[,:;-])\s*" + _FULL_NAME)

_GIVEN = frozenset(GIVEN_NAMES.split())
_STOP = frozenset(COMMON_WORDS.split())
_NOT_FAMILY = _STOP | frozenset(STREET_WORDS.split()) | frozenset(FIRM_WORDS.split())
_PLACE_NEXT = frozenset(STREET_WORDS.split()) | frozenset("motors motor auto autos automotive garage tires service services center centre group shop body brothers bros company corp inc llc ltd towing repair".split())
# Words that open or end names of makes, firms, offices, places and times, not of persons.
PROPER_WORDS = (
    "acura alfa audi bmw buick cadillac chevrolet chevy chrysler dodge ferrari fiat ford freightliner genesis gmc general honda hyundai infiniti isuzu jaguar jeep kia lamborghini land lexus lincoln lucid "
    "maserati mazda mercedes mercury mini mitsubishi nissan oldsmobile peterbilt polestar pontiac porsche ram rivian rover saab saturn scion smart subaru suzuki tesla toyota volkswagen volvo vw yamaha harley benz "
    "north south east west new san los las saint fort mount united states america american national federal state northern southern eastern western central "
    "january february march april june july august september october november december monday tuesday wednesday thursday friday saturday sunday "
    "customer care relations assistance roadside department office recall safety traffic highway administration nhtsa dot insurance support sales parts engine air bag power steering brake fuel check light "
    "police sheriff fire emergency better business bureau attorney consumer consumers report reports complaint campaign vehicle car truck model year make dear god jesus lord christmas thanksgiving"
)
_NOT_NAME = _NOT_FAMILY | frozenset(f"{PROPER_WORDS} {RELATIONS} {ROLES}".split())
_OUTRIGHT_WORDS = frozenset("name registered signed".split())
_BIRTH_WORDS = frozenset("dob d birth birthday birthdate born".split())
_CUE_WORDS = frozenset("name names am m this with to ask asked asking for contact call reach email mail text page contacted called told emailed under in by signed sincerely regards attn attention c reported filed behalf".split()) | frozenset(f"{RELATIONS} {ROLES} {PERSON_ACTS}".replace("co-owner", "owner").split()) | {"dealer", "dealership", "service", "shop", "garage", "parts"}
_TITLES = frozenset("mr mrs ms dr miss prof sir madam".split())
_ID_WORDS = frozenset("ssn soc social passport dl d s license licence licenses licences".split())
_STREET_SET = frozenset(STREET_WORDS.split()) | frozenset(STREETS_BEFORE.split())
_NEXT_WORD = re.compile(r"[^\W\d_.;,!?*\n]*[ \t-]+([^\W\d_]+)")
_UNSUITED = re.compile(r"\b(?:miles?|months?|weeks?|days?|hours?|years?|times?|on|of|at|in|the|and|from|to|near|mph|for|was|is|were|we|i|my|it|a|an|with|by|after|before|until|when|while|or)\b", re.I)


def _name_style(text: str, a: int, c: int) -> bool:
    """Both words of a name are written alike: capitalised each, or the text does not tell by case (it has no capitals)."""
    if text[a].islower() and text != text.lower():
        return False
    return text[a].isupper() == text[c].isupper() or text[c : c + 2] in ("o'", "d'")


def _find_given(text: str, found: _Found) -> None:
    """Names with a known given name: family name behind it, or before it and a comma where a word says who is meant."""
    for m in _TOKEN.finditer(text):
        word = m[0].lower()
        if word not in _GIVEN:
            word = word.split("-", 1)[0]
            if word not in _GIVEN:
                continue
        a, b = m.start(), m.start() + len(word)
        if text[b : b + 1] == "'" or not found.free(a, b):
            continue
        after = _AFTER_GIVEN.match(text, b)
        if after:
            c, d = after.span("fam")
            following = _NEXT_WORD.match(text, d)
            placed = following and following[1].lower() in _PLACE_NEXT
            if text[c:d].lower() in _GIVEN and (last := _AFTER_GIVEN.match(text, d)) and last["fam"].lower() not in _NOT_NAME and text[a].isupper() and _proper(last["fam"]):
                d = last.end("fam")  # two given names
            if text[c:d].lower() not in _NOT_FAMILY and not placed and _name_style(text, a, c) and found.free(a, d):
                found.add(NAME, a, d)
                continue
        before = _BEFORE_GIVEN.search(text, max(0, a - 60), a)
        if before:
            c = before.start("fam")
            family = before["fam"].lower()
            if family not in _NOT_FAMILY and family not in _GIVEN and found.free(c, b) and _OWNER_CUE.search(text, max(0, c - 20), c):
                found.add(NAME, c, b)


class _Found:
    """Mentions that do not overlap, in order of place; a look-up costs the logarithm of their number."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.stops: list[int] = []
        self.kinds: list[str] = []

    def free(self, a: int, b: int) -> bool:
        at = bisect.bisect_left(self.starts, b)
        return at == 0 or self.stops[at - 1] <= a

    def add(self, kind: str, a: int, b: int) -> None:
        at = bisect.bisect_left(self.starts, a)
        self.starts.insert(at, a)
        self.stops.insert(at, b)
        self.kinds.insert(at, kind)


def find_mentions(text: str | None) -> list[tuple[str, int, int]]:
    """Mentions (kind, start, stop) of a text, by place; start counts from 0 and stop is exclusive."""
    if not text:
        return []
    found = _Found()
    low = text.lower()
    words = frozenset(_WORDS.findall(low))
    if "@" in low or "dot" in words or ("at" in words and _AT.search(low)):
        for m in _EMAIL.finditer(text):
            found.add(EMAIL, *m.span())
    if not words.isdisjoint(_ID_WORDS):
        for cue in _ID_CUE.finditer(text):
            m = _ID_VALUE[cue.lastgroup].match(text, cue.end())
            if m and found.free(*m.span("v")) and (cue.lastgroup != "ssn" or valid_ssn(m["v"])):
                found.add(IDENTITY, *m.span("v"))
    if _DIGIT.search(text):
        _find_numbers(text, low, words, found)
    if not words.isdisjoint(_GIVEN):
        _find_given(text, found)
    if not words.isdisjoint(_TITLES):
        _find_titled(text, found)
    if not words.isdisjoint(_CUE_WORDS):
        _find_cued(text, low, words, found)
    return list(zip(found.kinds, found.starts, found.stops))


def _find_numbers(text: str, low: str, words: frozenset[str], found: _Found) -> None:
    """Birth dates, social security numbers without a cue, telephone numbers, post boxes and street addresses."""
    if not words.isdisjoint(_BIRTH_WORDS):
        for m in _BIRTH.finditer(text):
            if found.free(*m.span("v")) and read_date(m["v"]):
                found.add(BIRTH_DATE, *m.span("v"))
    for m in _BARE_SSN.finditer(text):
        if found.free(*m.span()) and valid_ssn(m[0]):
            found.add(IDENTITY, *m.span())
    if _LINE_NUMBER.search(text):
        for m in _PHONE.finditer(text):
            if found.free(*m.span()) and valid_phone(m[0]):
                found.add(PHONE, *m.span())
    if "box" in low:
        for m in _BOX.finditer(text):
            if found.free(*m.span()):
                found.add(ADDRESS, *m.span())
    if words.isdisjoint(_STREET_SET):
        return
    at = 0
    while m := _ADDRESS.search(text, at):
        at = m.end()
        middle = m["mid"]
        if middle is not None and _UNSUITED.search(middle):
            at = m.start() + 1
            while at < len(text) and text[at].isdigit():
                at += 1
            continue
        if found.free(*m.span()):
            found.add(ADDRESS, *m.span())


def _find_titled(text: str, found: _Found) -> None:
    """Family names behind a title."""
    for m in _TITLE.finditer(text):
        a, b = m.span("fam")
        if m["fam"].lower() in _NOT_FAMILY or not found.free(a, b):
            continue
        if m["t"].lower() == "dr" and not _TITLE_BEFORE.search(text, max(0, m.start() - 30), m.start()):
            continue
        found.add(NAME, a, b)


def _proper(word: str) -> bool:
    """Written as a name within a sentence: a capital and small letters behind it."""
    bare = word[2:] if word[1:2] in ("'", "’", "`") else word
    return word[0].isupper() and bare[:1].isupper() and not bare[1:].isupper()


def _find_cued(text: str, low: str, words: frozenset[str], found: _Found) -> None:
    """Names told by what stands around them, whatever the words: two or three words with a capital after a word that says
    a person follows, or before what only persons do; in a text without case the cue must be one of those that name outright."""
    starts = [w[0].isupper() for w in _WORDS.findall(text)]
    cased = text not in (low, text.upper()) and (len(starts) < 10 or sum(starts) < 0.75 * len(starts))
    if not cased and words.isdisjoint(_OUTRIGHT_WORDS):
        return
    find = (_CAPITALS if cased else _NAMED_OUTRIGHT).search
    at = 0
    while m := find(text, at):
        a, b = m.start("given"), m.end("fam")
        at = m.end("given")
        parts = [p for p in (m["given"], m["more"], m["fam"]) if p]
        if m["more"] and m["fam"].lower() in _NOT_NAME:  # the next sentence begins
            parts, b = parts[:2], m.end("more")
        if any(p.lower() in _NOT_NAME for p in parts) or (cased and not all(map(_proper, parts))):
            continue
        if cased and not _PERSON_AFTER.match(text, b) and not _PERSON_BEFORE.search(text, max(0, a - 40), a):
            continue
        following = _NEXT_WORD.match(text, b)
        if (following and following[1].lower() in _PLACE_NEXT) or not found.free(a, b):
            continue
        found.add(NAME, a, b)
        at = b


def valid_ssn(written: str) -> bool:
    """Nine digits of which neither area, group nor serial is all zeros."""
    d = re.sub(r"\D", "", written)
    return len(d) == 9 and d[:3] != "000" and d[3:5] != "00" and d[5:] != "0000"


def valid_phone(written: str) -> bool:
    """Ten digits of area, exchange and line, or eleven that begin with a country code; no area code begins with 0 or 1."""
    digits = re.sub(r"\D", "", written)
    local = digits[-10:]
    return len(digits) <= 12 and local[0] not in "01" and len(set(local)) > 1


def _once(texts: Iterator[pd.Series], make, nothing) -> Iterator[pd.Series]:
    """Applies ``make`` to each distinct text of a batch."""
    for series in texts:
        codes, values = pd.factorize(series)
        rows = [make(v) for v in values] + [nothing]
        yield pd.Series([rows[c] for c in codes], index=series.index, dtype=object)


def mentions_column(text: Column, key: bytes) -> Column:
    """The mentions of a text column with their placeholders; equal texts of a batch are searched once."""

    @F.pandas_udf(MENTION_SCHEMA)
    def search(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from _once(texts, lambda t: [{"kind": k, "start_pos": a + 1, "stop_pos": b + 1, "placeholder": pseudonym(k, t[a:b], key)} for k, a, b in find_mentions(t)], [])

    return search.asNondeterministic()(text)  # else a filter on the result is pushed below and searches every text again


def mentions(df: DataFrame, record: str, text: str, key: bytes) -> DataFrame:
    """Distinct rows (record, kind, start_pos, stop_pos, placeholder): what ``redact_column`` puts where."""
    texts = spread(df.filter(F.col(text).isNotNull()).select(F.col(record).alias("_key"), F.col(text).alias("_text")))
    found = texts.select("_key", mentions_column(F.col("_text"), key).alias("_m")).filter(F.size("_m") > 0)
    return found.select(F.col("_key").alias(record), F.explode("_m").alias("m")).select(record, "m.*").distinct()


# --- placeholders ---


def pseudonym(kind: str, value: str, key: bytes) -> str:
    """The typed placeholder of a mention."""
    if kind == PHONE:
        extra = len(re.sub(r"\D", "", value)) - 10
        return f"[PHONE {permute_valid(value, key, b'phone', valid_phone, keep=max(0, extra))}]"
    if kind == IDENTITY:
        valid = valid_ssn if re.fullmatch(r"\d{3}[-. ]?\d{2}[-. ]?\d{4}", value) else lambda _: True
        return f"[ID_NUMBER {permute_valid(value, key, b'id', valid)}]"
    if kind == BIRTH_DATE:
        day, put = read_date(value)
        return f"[BIRTH_DATE {put(permute_date(day, key))}]"
    if kind == ADDRESS:
        number = re.match(r"\d+", value)
        return f"[STREET_ADDRESS {permute_within(number[0], key, b'house') + ' ' if number else ''}{code(value, key, kind)}]"
    if kind == EMAIL:
        plain = re.sub(r"\s*[(\[{]?\s*\bdot\b\s*[)\]}]?\s*", ".", re.sub(r"\s*(?:@|[(\[{]\s*at\s*[)\]}]|\bat\b)\s*", "@", value, count=1, flags=re.I), flags=re.I)
        return f"[EMAIL {code(plain, key, kind)}]"
    family_first = re.match(r"(.+?)\s*,\s*(.+)$", value)
    return f"[NAME {code(f'{family_first[2]} {family_first[1]}' if family_first else value, key, kind)}]"


def redact(text: str | None, key: bytes) -> str | None:
    """The text with every mention replaced by its placeholder; everything else as it was."""
    if not text:
        return text
    out, at = [], 0
    for kind, a, b in find_mentions(text):
        out += [text[at:a], pseudonym(kind, text[a:b], key)]
        at = b
    return "".join([*out, text[at:]])


def redact_column(text: Column, key: bytes) -> Column:
    """The redacted form of a text column."""

    @F.pandas_udf("string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from _once(texts, lambda t: redact(t, key), None)

    return run(text)
