"""Field parsers: one DataFrame per function."""

from __future__ import annotations

import random
import re
from datetime import date

import pytest

from leadlane import rules
from leadlane.functions import contact, dates, numbers, text


def check(evaluate, expression, cases):
    assert evaluate(expression, list(cases)) == list(cases.values())


def test_clean_text(evaluate):
    cases = {
        "  Ada  ": "Ada", "Head   of   Ops": "Head of Ops", "a\t\n b": "a b", "　x y\x1c": "x y", "é  è": "é è",
        None: None, "": None, "   ": None, "nan": None, "NaN": None, "N/A": None, " - ": None, "?": None, "Null": None,
        "none": None, "na": None, "nano": "nano", "--": "--",
    }
    check(evaluate, text.clean_text, cases)


def test_clean_source(evaluate):
    check(evaluate, text.clean_source, {" Cold  Reply ": "cold reply", "": None})


def test_whitespace_is_the_same_set_as_pythons(evaluate):
    spaces = [chr(c) for c in range(0x10000) if chr(c).isspace()]
    assert evaluate(text.clean_text, [f"{c}a{c}{c}b{c}" for c in spaces]) == ["a b"] * len(spaces)


def test_capitalize(evaluate):
    check(evaluate, text.capitalize, {"agency ICP fit": "Agency icp fit", "x": "X", "": "", "QA": "Qa"})


def test_clean_email(evaluate):
    cases = {
        "Ada@LuxAuto.io": ("ada@luxauto.io", True), "ola[at]growth.agency": ("ola@growth.agency", True),
        "sophie(at)omniside.agency": ("sophie@omniside.agency", True), "a [ AT ] b.co": ("a@b.co", True),
        "ivan@": ("ivan@", False), "weird-email-no-domain": (None, False),
        "deji m.@scaleforge": ("dejim.@scaleforge", False), "a@b@c.d": ("a@b@c.d", False), "a\tb@c.d": ("a\tb@c.d", False),
        "a@.b": ("a@.b", False), "a@b.": ("a@b.", False), "@b.c": ("@b.c", False), "": (None, False), None: (None, False),
    }
    check(evaluate, lambda c: contact.clean_email(c), cases)


def test_email_domain(evaluate):
    cases = {"ada@luxauto.io": "luxauto.io", None: None, "notanemail": None, "a@b@c.d": "c.d", "a@": None}
    check(evaluate, contact.email_domain, cases)


def test_clean_website(evaluate):
    cases = {
        "www.luxauto.io": "luxauto.io", "http://upshiftloop.agency": "upshiftloop.agency",
        "https://www.Brightline.io/": "brightline.io", "luxauto.io": "luxauto.io", "HTTPS://WWW.x.io//": "x.io",
        "x.io/a?b=C": "x.io/a?b=c", "https://": None, "x.io /": "x.io", "": None, None: None,
    }
    check(evaluate, contact.clean_website, cases)


def test_parse_lead_id(evaluate):
    cases = {
        "L-1369": ("L-1369", "1369", False, True), " 1341 ": ("1341", "1341", False, True),
        "L-1205-dup": ("L-1205-dup", "1205", True, True), "L-9-DUP": ("L-9-DUP", None, True, False),
        "L-2024-1369": ("L-2024-1369", "2024", False, True), "L-7": ("L-7", None, False, False),
        "asdf": ("asdf", None, False, False), "": (None, None, False, False), None: (None, None, False, False),
    }
    check(evaluate, contact.parse_lead_id, cases)


def test_parse_employees(evaluate):
    cases = {
        "20": 20.0, "35-55": 45.0, "~43": 43.0, "70+": 70.0, "28 - 48": 38.0, "1,200": 1.0, "2.5k": 2.0, "35–55": 35.0,
        "about 30 people": 30.0, "~ 5": 5.0, "x-y 7": 7.0, "²": None, "asdf": None, "": None, None: None,
    }
    check(evaluate, numbers.parse_employees, cases)


def test_parse_budget(evaluate):
    cases = {
        "5,000/mo": 5000.0, "$6k/mo": 6000.0, "6k": 6000.0, "$8,500": 8500.0, "$9,000": 9000.0, "10,000": 10000.0,
        "15k/mo": 15000.0, "0": 0.0, "500": 500.0, "$6-8k": 7000.0, "5k-7k": 6000.0, "8k-12k": 10000.0, "6k - 8": 7000.0,
        "2.5K per month": 2500.0, "4000 / month": 4000.0, "1000-2000": 1500.0, "5000/mo.": None, "~5k": None, "5m": None,
        "TBD": None, "depends": None, "unknown": None, "?": None, "": None, None: None,
    }
    check(evaluate, numbers.parse_budget, cases)


def test_parse_date(evaluate):
    cases = {
        "06/28/2024": date(2024, 6, 28), "2024-06-08": date(2024, 6, 8), "2024-6-19": date(2024, 6, 19),
        "Jun 7 2024": date(2024, 6, 7), "04-06-2024": date(2024, 6, 4), "6/1/24": date(2024, 6, 1),
        "13/05/2024": date(2024, 5, 13), "05-13-2024": date(2024, 5, 13), "2024-13-05": None, "2024-02-30": None,
        "2024-06-08 10:00": date(2024, 8, 6), "June 7, 2024": date(2024, 6, 7), "7th of June 2024": date(2024, 6, 7),
        "7-Jun-24": date(2024, 6, 7), "20240608": date(2024, 6, 8), "Friday, June 7 2024": date(2024, 6, 7), "Tues June 4 2024": None, "tue 4 jun 2024": date(2024, 6, 4),
        "asdf": None, "2024": None, "June": None, "06/28": None, "": None, None: None,
    }
    check(evaluate, dates.parse_date, cases)


def test_two_digit_years_belong_to_the_nearest_century(evaluate):
    this_year = date.today().year
    years = [(this_year + d) % 100 for d in (-49, -10, 0, 10, 49)]
    got = evaluate(dates.parse_date, [f"6/15/{y:02d}" for y in years])
    assert [d.year for d in got] == [this_year + d for d in (-49, -10, 0, 10, 49)]


def test_dates_agree_with_a_public_parser(evaluate):
    parser = pytest.importorskip("dateutil.parser")
    rng = random.Random(7)
    shapes = (
        "{m:02d}/{d:02d}/{y}", "{m}/{d}/{s:02d}", "{y}-{m:02d}-{d:02d}", "{y}-{m}-{d}", "{d:02d}-{m:02d}-{y}",
        "{d}-{m}-{s:02d}", "{n} {d} {y}", "{n} {d}, {y}", "{d} {n} {y}", "{y}/{m}/{d}", "{d}.{m}.{y}", "{d}-{n}-{y}",
        "{y}-{m:02d}-{d:02d} 09:30", "{m}/{d}/{y} 3:05 PM", "{y}{m:02d}{d:02d}",
        "{m}/{d}/{y}, 10:30 AM", "{m}/{d}/{y} 3 PM", "12:30 {m:02d}/{d:02d}/{y}", "{m:02d}/{d:02d}/{y} 10:00 EST",
        "{n} {d} 10:00:00 {y}", "{n} {d}, {y} at 5:00 PM", "{m:02d}/{d:02d}/{y} 25:99", "{m:02d}/{d:02d}/{y} 13 PM",
        "{y}-{m:02d}-{d:02d}T23:59:59Z", "{y}-{m:02d}-{d:02d}T08:00:00+02:00", "{m}/{d}/{y} 9:61", "{n} {d} {y} 11:15:30.25 pm",
    )
    names = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
    full = "January February March April May June July August September October November December".split()
    texts = []
    for _ in range(1500):
        y, m, d = rng.randint(1990, 2040), rng.randint(1, 14), rng.randint(1, 32)
        name = rng.choice((names, full))[(m - 1) % 12]
        texts.append(rng.choice(shapes).format(y=y, m=m, d=d, s=y % 100, n=name))

    def expected(value):
        iso = len(value) <= 10 and value[:4].isdigit() and value.count("-") == 2 and value[4] == "-"
        try:
            return parser.parse(value, dayfirst="-" in value and not iso).date()
        except (ValueError, OverflowError):
            return None

    got = evaluate(dates.parse_date, texts)
    assert [(t, g) for t, g in zip(texts, got)] == [(t, expected(t)) for t in texts]


def test_phrase_patterns_match_like_a_plain_search(evaluate):
    """Every pattern, on texts made of its own phrases and near misses, against Python's search."""
    import re

    patterns = [p for _, p, _ in rules.HARD_DISQUALIFIERS] + [p for *_, p, _ in rules.INTENT_SIGNALS]
    patterns += [rules.NOT_AGENCY_PATTERN, rules.AGENCY_PATTERN, rules.ADJACENT_PATTERN]
    samples = [
        "attaching cv", "attaching my cv", "attaching mycv", "vc here", "avc here", "vc hereby", "cs student", "cs students",
        "journalist", "journalists", "éjournalist", "at $5/hr", "at $25 / hr now", "$x/hr", "$5/hrs", "wont share budget",
        "won't share budget", "wonxxt share budget", "newsletter signup made by mistake", "mistake, newsletter signup",
        "budgeted serious", "budgeted,serious", "budgeted, serious", "budgeted and serious", "real budget",
        "no real budget", "no real budget yet", "no real budget but a real budget", "unreal budget", "real budgets",
        "cant really pay right now", "can't really pay right now", "agency", "agencys", "not an agency", "interagency", "",
    ]
    samples += [phrase for p in patterns for phrase in p.split("|") if re.fullmatch(r"[\w\s/-]+", phrase)]
    for pattern in patterns:
        found = evaluate(lambda c: text.matches(c, pattern), samples)
        assert found == [bool(re.search(pattern, s)) for s in samples], pattern


def test_case_folding_covers_the_special_letters(evaluate):
    check(evaluate, text.fold_case, {"Price ſenſitive": "price sensitive", "tıny": "tiny", "ABC": "abc"})


def test_squeeze_finds_every_whitespace_without_a_pattern(evaluate):
    from pyspark.sql import functions as F

    from leadlane.functions.text import WHITESPACE, squeeze

    texts = [f"a{w}b" for w in WHITESPACE] + [f"a{w} b c" for w in WHITESPACE] + ["a b  c", "a b", "a\x00b\x7f c", "é b", "é\u2003 b", "", None]
    expected = [None if t is None else re.sub(f"[{re.escape(WHITESPACE)}]+", " ", t) for t in texts]
    assert evaluate(squeeze, texts) == expected
    condition = str(squeeze(F.col("v"))).split(" THEN ")[0]
    assert "RLIKE" not in condition.upper()
