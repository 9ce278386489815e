"""Personal information: mentions, traps, and reversible pseudonyms."""

from __future__ import annotations

import datetime as dt
import itertools
import re

import pytest

from caseloom.llm import pii
from caseloom.llm import pseudonyms as ps

CASES = [
    ("Call me at (613)5550192 ext 301.", [("phone", "(613)5550192")]),
    ("ph# +1 442 555 0104 any time", [("phone", "+1 442 555 0104")]),
    ("MY CELL IS 1-599-555-0190.", [("phone", "1-599-555-0190")]),
    ("tel. 948/555-0139", [("phone", "948/555-0139")]),
    ("Reach me (brian_m75 (at) mail.example.com - thanks", [("email", "brian_m75 (at) mail.example.com")]),
    ("e-mail a+b [at] mail dot example dot org.", [("email", "a+b [at] mail dot example dot org")]),
    ("My email is x.y-z @ example.org please", [("email", "x.y-z @ example.org")]),
    ("Write to JOAN+CAR@EXAMPLE.COM. I like it", [("email", "JOAN+CAR@EXAMPLE.COM")]),
    ("It happened at night.", []),
    ("It was parked at 5 Larkmere Avenue Unit 61", [("street_address", "5 Larkmere Avenue")]),
    ("i live at 4 se bellweather terrace; thanks", [("street_address", "4 se bellweather terrace")]),
    ("Home: 684-B Avenida del Roble.", [("street_address", "684-B Avenida del Roble")]),
    ("mail: 63½ Calle Verano", [("street_address", "63½ Calle Verano")]),
    ("at 59 St. Alban Dr in", [("street_address", "59 St. Alban Dr")]),
    ("2406 W 14th Drive", [("street_address", "2406 W 14th Drive")]),
    ("Send it to P O BOX 9737; or RR 9, Box 868", [("street_address", "P O BOX 9737"), ("street_address", "RR 9, Box 868")]),
    ("It happened on Maple Hollow Blvd near exit 79.", []),
    ("I drove 16,270 miles on Route 76.", []),
    ("it did it 10 times on Iron Kettle Drive", []),
    ("SSN: 989.99.1633 on file", [("id_number", "989.99.1633")]),
    ("They asked for my social, which is 944294046.", [("id_number", "944294046")]),
    ("my driver's license is B517-9204-7271.", [("id_number", "B517-9204-7271")]),
    ("license number (driver) D80311597", [("id_number", "D80311597")]),
    ("DL# H259-5345-5492", [("id_number", "H259-5345-5492")]),
    ("Passport no. X75219740", [("id_number", "X75219740")]),
    ("The claim number is SR11824707. VIN ends in LGN0ZEKX. The tire code reads HJZT-86925-BR.", []),
    ("Registered to Joan Vandrstad since new.", [("name", "Joan Vandrstad")]),
    ("Owner: O'Dorrvway, Brian; x", [("name", "O'Dorrvway, Brian")]),
    ("THE OTHER DRIVER WAS GRACE H. RUSKVELL-MORKELL.", [("name", "GRACE H. RUSKVELL-MORKELL")]),
    ("i spoke with inés gostard who hung up", [("name", "inés gostard")]),
    ("The adviser, Mr. O'Ruskvway, did nothing. Ask for Dr. Teldez.", [("name", "O'Ruskvway"), ("name", "Teldez")]),
    ("The invoice from Grant Road Autos was $65. Faith & Sons Body Shop. Martin Hill Tires.", []),
    ("I live at 3 Old Mill Dr. The car died.", [("street_address", "3 Old Mill Dr")]),
    ("Owner name [XXX], phone [XXX].", []),
    ("The walter pump kept overheating.", []),
    ("", []),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_mentions(text, want):
    assert [(k, text[a:b]) for k, a, b in pii.find_mentions(text)] == want


def test_null_and_long():
    assert pii.find_mentions(None) == []
    text = "ok. " * 50_000 + "Call me at 613-555-0192."
    assert pii.find_mentions(text) == [("phone", 200_011, 200_023)]
    many = "Call 613-555-0192 or ask Zachary Nguyen. " * 5000
    assert len(pii.find_mentions(many)) == 10_000


# Held-out names and places: none of these words stands in the lists of the module or in the test tables.
GIVEN = "Zachary Priyanka Hiroshi Danielle Sofia Logan Chloe Jack Mike Bob Oluwaseun Krzysztof Xiomara Tyrone Brigitte Siobhán Mateusz Anjali Derek Wendy".split()
FAMILY = "Nguyen Raghunathan Tanaka Brooks Rossi Pierce Baker Miller Johnson Stevens Adeyemi Kowalczyk Villanueva Washington Dubois O'Sullivan Lindqvist Patel Hargreaves Cho".split()
SENTENCES = (
    "My name is {}.", "I spoke with {} about the stalling.", "Owner: {}.", "Please call {} when parts arrive.", "My wife {} was driving.", "The other driver was {}.", "My sister {} smelled smoke.", "Service adviser {} looked at it.",
    "I am {} and I own this car.", "My husband {} had it towed.", "It was registered to {} at that time.", "{} told me it was normal.", "I was told by the manager, {}, to wait.", "It belongs to {} now.", "Sincerely, {}", "I asked for {} twice.", "{} at the dealership refused to look.", "I talked to {} again.",
    "Our neighbor {} helped me.", "The car was sold to {} in May.", "A letter came from {} last week.", "I wrote to {} in vain.",
)
NO_NAMES = (
    "I spoke with Bright Meadow Motors.", "I called Toyota Customer Care.", "My wife drove to Cedar Rapids.", "It happened on Willow Bend Parkway.", "General Motors told me to wait.", "The Ford Explorer told us nothing.", "Contact National Highway Traffic.", "I bought it from Sunrise Auto Group.",
    "The Check Engine Light came on.", "The manager said Air Bag Recall parts are late.", "I live near Grand Forks.", "My friend has a Honda Civic.", "Dealer: Lakeside Chevrolet Buick.", "We drove to San Antonio and back.", "It was towed by Blue Ridge Towing.", "In January Consumer Reports said so.", "My mother and I left.", "The owner of Pine Creek Garage said no.",
)


def test_names_outside_every_list():
    """Recall and precision of names by what stands around them, on words the module does not know."""
    assert not {g.lower() for g in GIVEN} & pii._GIVEN and not {f.lower() for f in FAMILY} & pii._NOT_NAME
    true = found = both = 0
    for n, given in enumerate(GIVEN):
        for k, sentence in enumerate(SENTENCES):
            name = f"{given} {'B. ' if k % 7 == 3 else ''}{FAMILY[(n * 7 + k) % len(FAMILY)]}"
            text = f"The brakes failed twice. {sentence.format(name)} {NO_NAMES[(n + k) % len(NO_NAMES)]}"
            got = {text[a:b] for kind, a, b in pii.find_mentions(text) if kind == "name"}
            true, found, both = true + 1, found + len(got), both + (name in got)
    assert both / true >= 0.9 and both / found >= 0.95


def test_addresses_outside_every_list():
    streets = "Kensington Juniper Sycamore Thornbury Cascade Winslow Harrow Applegate".split()
    for n, street in enumerate(streets):
        for word in ("Street", "Ave", "Blvd", "Lane", "Rd"):
            text = f"I live at {n * 37 + 2} {street} {word}, and {street} {word} is bumpy."
            assert [text[a:b] for kind, a, b in pii.find_mentions(text) if kind == "street_address"] == [f"{n * 37 + 2} {street} {word}"]


def test_social_security_numbers_are_validated():
    assert [pii.find_mentions(f"on file {v} since") != [] for v in ("123-45-6789", "000-45-6789", "123-00-6789", "123-45-0000")] == [True, False, False, False]
    assert pii.find_mentions("My SSN is 000-00-0000.") == []


@pytest.mark.parametrize("alphabet", [ps.DIGITS, ps.LETTERS])
def test_feistel_is_a_permutation(alphabet):
    key = b"k"
    for n in (1, 2, 3):
        every = ["".join(x) for x in itertools.product(alphabet, repeat=n)]
        fresh = [ps.feistel(x, key, alphabet=alphabet) for x in every]
        assert sorted(fresh) == every and [ps.feistel(x, key, alphabet=alphabet, inverse=True) for x in fresh] == every
    for value in ("00", "123", "5551234567", "999999999", "1" * 60):
        assert ps.feistel(ps.feistel(value, key), key, inverse=True) == value
    assert ps.feistel("5551234567", b"a") != ps.feistel("5551234567", b"b") and ps.feistel("", key) == ""


def test_equal_values_stay_linked_and_format_stays():
    key = b"k"
    a, b = (pii.redact(t, key) for t in ("call 613-555-0192 now", "tel (613)5550192"))
    assert re.search(r"\[PHONE \d{3}-\d{3}-\d{4}\]", a) and re.sub(r"\D", "", a) == re.sub(r"\D", "", b)
    assert pii.redact("My name is Beth Feskell", key).rsplit(" ", 1)[1] == pii.redact("Owner: FESKELL, BETH", key).rsplit(" ", 1)[1]
    assert pii.redact("nothing here", key) == "nothing here" and pii.redact(None, key) is None
    licence = re.search(r"\[ID_NUMBER ([A-Z]\d{3}-\d{4}-\d{4})\]", pii.redact("my driver's license is B517-9204-7271.", key))[1]
    assert ps.permute_within(licence, key, b"id", inverse=True) == "B517-9204-7271" and licence[0] != "B"


def test_dates():
    day = dt.date(1984, 2, 29)
    assert ps.permute_date(day, b"k") != day and ps.permute_date(ps.permute_date(day, b"k"), b"k", inverse=True) == day
    assert len({ps.permute_date(dt.date(2000, 1, 1) + dt.timedelta(i), b"k") for i in range(300)}) == 300
    got = [pii.redact(t, b"k") for t in ("DOB 02/29/1984", "born on Feb 29, 1984.", "date of birth: 1984-02-29", "born 02/30/1984", "It failed on 02/29/1984")]
    assert re.fullmatch(r"DOB \[BIRTH_DATE \d\d/\d\d/\d{4}\]", got[0]) and re.fullmatch(r"born on \[BIRTH_DATE [A-Z][a-z]{2} \d+, \d{4}\]\.", got[1]) and re.fullmatch(r"date of birth: \[BIRTH_DATE \d{4}-\d\d-\d\d\]", got[2])
    assert got[3:] == ["born 02/30/1984", "It failed on 02/29/1984"]
    m, d, y = re.search(r"(\d\d)/(\d\d)/(\d{4})", got[0]).groups()
    assert f"{y}-{m}-{d}" in got[2]  # the same day in another format


def test_rows(spark):
    df = spark.createDataFrame([("1", "SSN: 989.99.1633", 0), ("1", "SSN: 989.99.1633", 1), ("2", None, 2), ("3", "", 3), (None, "SSN: 989.99.1633", 4)], "cmplid string, cdescr string, kind int")
    rows = pii.mentions(df, "cmplid", "cdescr", b"k").collect()
    assert sorted((r["cmplid"] or "", r["kind"], r["start_pos"], r["stop_pos"]) for r in rows) == [("", "id_number", 6, 17), ("1", "id_number", 6, 17)]
    text = df.select(pii.redact_column(df.cdescr, b"k").alias("t"))
    assert text.filter("t IS NULL").count() == 1 and text.first()["t"] == "SSN: " + rows[0]["placeholder"]
    assert pii.mentions(df.limit(0), "cmplid", "cdescr", b"k").count() == 0
