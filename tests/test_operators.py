"""Junk rules, duplicate resolution, notes and scores."""

from __future__ import annotations

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from leadlane import rules
from leadlane.operators import clean, dedup, explore, notes, scoring
from leadlane.operators.quantiles import profile

RAW = "source_row long, " + ", ".join(f"{c} string" for c in rules.COLUMNS)


def raw_rows(spark, *rows):
    """Raw leads from dicts; missing cells are empty."""
    data = [(i, *[row.get(c, "") for c in rules.COLUMNS]) for i, row in enumerate(rows, 2)]
    return spark.createDataFrame(data, RAW)


def by_row(df, column):
    return [row[column] for row in df.select("source_row", column).orderBy("source_row").collect()]


def test_junk_reasons(spark):
    asdf = {c: "asdf" for c in rules.COLUMNS}
    rows = [
        {}, {"notes": "   "}, {"lead_id": "n/a", "name": "?"},
        {"lead_id": "header", "created": "lead_id", "name": "name"}, {"lead_id": "LEAD_ID", "email": "x@y.z"},
        {"lead_id": "L-1", "name": "name", "email": "Email"}, {"lead_id": "L-1", "name": "name"},
        {"lead_id": "L-12", "name": "name", "email": "a@b.c"},
        {"lead_id": "TESTROW"}, {"lead_id": "L-1", "notes": "QA test entry, please ignore."}, asdf,
        {"lead_id": "L-11", "name": "Ünü", "company": "ünü", "title": "ÜNÜ"},
        {"lead_id": "L-11", "name": "a1", "company": "a1", "title": "a1"},
        {"lead_id": "L-11", "name": "abcdefg", "company": "abcdefg", "title": "abcdefg"},
        {"lead_id": "L-11", "name": "abc", "company": "abc"},
        {"lead_id": "L-11", "name": "abc", "company": "abc", "title": "abd", "source": "abc"},
        {"lead_id": "L-1369", "name": "Ada", "company": "LuxAuto", "title": "Owner", "source": "webform"},
    ]
    blank, header, test = rules.BLANK_ROW, rules.HEADER_ROW, rules.TEST_ROW
    expected = [blank] * 3 + [header] * 4 + [None] + [test] * 4 + [None] * 5
    assert by_row(clean.with_junk_reason(raw_rows(spark, *rows)), "reason") == expected


def test_clean_records(spark):
    row = {
        "lead_id": " L-1205-dup", "created": "asdf  x", "name": " Ada  L ", "email": "Ada[at]X.io", "employees": "35-55",
        "website": "https://www.X.io/", "title": "CEO", "source": "Web Form", "monthly_budget": "$6-8k", "notes": " a   b ",
    }
    got = clean.clean_records(raw_rows(spark, row, {"lead_id": "L-7", "created": "6/1/24"})).orderBy("source_row").collect()
    assert tuple(got[0].asDict().keys()) == clean.CLEAN_COLUMNS
    assert got[0].asDict() == {
        "source_row": 2, "lead_id_raw": "L-1205-dup", "lead_id_canonical": "1205", "lead_id_is_explicit_dup": True,
        "lead_id": "L-1205-dup", "created_raw": "asdf  x", "created_date": None, "created": "asdf x", "name": "Ada L",
        "email": "ada@x.io", "email_valid": True, "company": None, "employees": 45.0, "website": "x.io", "title": "CEO",
        "source": "web form", "monthly_budget": 7000.0, "notes": "a b",
    }
    assert (got[1]["lead_id"], got[1]["created"], got[1]["notes"]) == ("ROW-3", "2024-06-01", "")


def test_missing_columns_and_missing_row_numbers_are_errors(spark):
    with pytest.raises(ValueError, match="No column"):
        clean.to_cells(spark.createDataFrame([("x",)], "lead_id string"))
    with pytest.raises(ValueError, match="source_row"):
        clean.to_cells(raw_rows(spark, {}).drop("source_row"))


# --- duplicates -----------------------------------------------------------------------------------------

CLEAN = (
    "source_row long, lead_id_raw string, lead_id_canonical string, created_date date, name string, email string, "
    "company string, employees double, website string, title string, source string, monthly_budget double, notes string"
)
# Every field filled, so that each case only names what differs.
BASE = {
    "lead_id_raw": "L-1000", "lead_id_canonical": "1000", "created_date": date(2022, 9, 14), "name": "Tamsin Reyes",
    "email": "t.reyes@fernhill.example", "company": "Fernhill", "employees": 27.0, "website": "fernhill.example",
    "title": "Owner", "source": "referral", "monthly_budget": 3200.0, "notes": "Would like a call in spring.",
}


def records(spark, *changes):
    names = [part.split()[0] for part in CLEAN.split(", ")]
    data = [tuple((BASE | change | {"source_row": i})[n] for n in names) for i, change in enumerate(changes)]
    return spark.createDataFrame(data, CLEAN)


@pytest.mark.parametrize(
    "changes, duplicate_of",
    [
        ([{}, {"lead_id_canonical": "1001"}], [None, None]),
        ([{"notes": "(Duplicate Submission) x", "lead_id_raw": "L-1000-dup"}, {}], ["L-1000", None]),
        ([{"lead_id_raw": "1373"}, {"lead_id_raw": "L-1373"}], [None, "1373"]),
        ([{"website": None, "title": ""}, {}], ["L-1000", None]),
        ([{"monthly_budget": None}, {"monthly_budget": 0.0}], ["L-1000", None]),
        ([{"created_date": date(2022, 9, 14)}, {"created_date": date(2022, 10, 2)}], ["L-1000", None]),
        ([{"created_date": None}, {"created_date": date(1, 1, 1)}], ["L-1000", None]),
        ([{"lead_id_canonical": None}, {"lead_id_canonical": None}, {"lead_id_canonical": ""}], [None, None, None]),
        ([{"lead_id_raw": None}, {"lead_id_raw": ""}], [None, "1000"]),
        (
            [{"notes": "(duplicate submission) x"}, {"lead_id_raw": "L-1"}, {"notes": "(duplicate submission) y"}],
            ["L-1", None, "L-1"],
        ),
    ],
)
def test_dedupe_preferences(spark, changes, duplicate_of):
    df = records(spark, *changes)
    for result in (dedup.dedupe(df), dedup.dedupe_by_window(df)):
        assert by_row(result, "duplicate_of") == duplicate_of
        assert by_row(result, "is_primary") == [d is None for d in duplicate_of]


def test_dedupe_by_other_key_and_fields(spark):
    df = records(spark, {"company": "A", "name": None}, {"company": "A", "email": None}, {"company": "B"})
    result = dedup.dedupe(df, key="company", completeness_fields=("name",))
    assert by_row(result, "is_primary") == [False, True, True]


def _skewed(spark, rows=4000):
    """A third of the rows in one group, a third without a key, the others in small groups."""
    rng = random.Random(3)
    changes = []
    for i in range(rows):
        key = [f"{rng.randint(10, 700)}", "2024", rng.choice([None, ""])][i % 3]
        changes.append(
            {
                "lead_id_canonical": key, "lead_id_raw": f"L-{key}-{i}", "title": rng.choice([None, "CEO"]),
                "created_date": rng.choice([None, date(2024, 6, 1), date(2024, 6, 2)]),
                "notes": rng.choice(["x", "(duplicate submission) x"]),
            }
        )
    return records(spark, *changes)


@pytest.mark.parametrize("hot_rows, hot_groups, small", [(100_000, 10_000, 1 << 30), (100_000, 10_000, 0), (100, 10_000, 0), (2, 5, 0)])
def test_dedupe_of_skewed_keys_equals_the_window_form(spark, monkeypatch, hot_rows, hot_groups, small):
    """Whichever groups go through the broadcast, and however many are beyond its bound."""
    monkeypatch.setattr(dedup, "BROADCAST_BYTES", small)
    monkeypatch.setattr(dedup, "HOT_GROUP_ROWS", hot_rows)
    monkeypatch.setattr(dedup, "HOT_GROUPS", hot_groups)
    df = _skewed(spark)
    expected = dedup.dedupe_by_window(df).select("source_row", "is_primary", "duplicate_of").collect()
    got = dedup.dedupe(df).select("source_row", "is_primary", "duplicate_of").collect()
    assert sorted(got) == sorted(expected)
    assert {len(rows) for rows in (got, expected)} == {4000}


def test_only_rows_that_may_have_a_partner_are_shuffled(spark, monkeypatch, tmp_path):
    """The plan for large data: single rows stay in place, and a filter of bounded size finds the others."""
    monkeypatch.setattr(dedup, "BROADCAST_BYTES", 0)
    changes = [{"lead_id_canonical": str(i if i % 10 else i // 50), "notes": "n" * 50} for i in range(1, 3001)]
    records(spark, *changes).repartition(4, "source_row").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    expected = sorted(dedup.dedupe_by_window(df).select("source_row", "duplicate_of").collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        result = dedup.dedupe(df)
        plan = result._jdf.queryExecution().executedPlan().toString()
        assert sorted(result.select("source_row", "duplicate_of").collect()) == expected
        # The filter stands in front of the exchange, and only one of two branches has an exchange of wide rows.
        wide = [line for line in plan.splitlines() if "Exchange hashpartitioning(look_up" in line]
        branches = plan.split("Union")[1]
        assert len(wide) == 1 and branches.index("SortMergeJoin") < branches.index("getbit")
        from leadlane.operators.key_filter import blocks_for, key_filter, with_may_hold

        won = dedup.best_per_key(df, "lead_id_canonical", ("name",)).filter("group_rows > 1")
        held = key_filter(won, "win_key", blocks_for(won.count()))
        marked = with_may_hold(df, held, F.col("lead_id_canonical"), blocks_for(won.count()), "may")
        group = marked.groupBy("lead_id_canonical").agg(F.count("*").alias("n"), F.min("may").alias("low"), F.max("may").alias("high"))
        assert group.filter("n > 1 AND NOT low").isEmpty() and group.filter("n = 1 AND high").count() < 60
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_key_filter_of_odd_keys(spark):
    from leadlane.operators.key_filter import key_filter, with_may_hold

    keys = spark.createDataFrame([("a",), ("é" * 1000,), ("",)], "k string")
    rows = spark.createDataFrame([("a",), (None,), ("",), ("é" * 1000,)] + [(f"x{i}",) for i in range(50)], "key string")
    for blocks in (1, 3, 131072):
        out = with_may_hold(rows, key_filter(keys, "k", blocks), F.col("key"), blocks, "may")
        assert {r["key"] for r in out.filter("may").collect()} == {"a", "", "é" * 1000}
        assert with_may_hold(rows, key_filter(keys.limit(0), "k", blocks), F.col("key"), blocks, "may").filter("may").isEmpty()


# --- notes ----------------------------------------------------------------------------------------------


def classify(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "source_row long, notes string")
    return notes.classify_notes(df).orderBy("source_row").collect()


def test_hard_disqualifiers(spark):
    cases = {
        "Good morning, I am looking for a role in your office": "job_seeker",
        "Are you hiring in Lisbon?": "job_seeker",
        "One of our portfolio companies might suit you": "investor_not_buyer",
        "I am a CS student with three questions": "student_researcher",
        "It is for a university project, thanks": "student_researcher",
        "As a journalist I would like to talk": "press_inquiry",
        "we are a competing automation agency in Oslo": "competitor",
        "Could you send pricing for benchmarking?": "competitor",
        "We place candidates in your town": "recruiter_pitch",
        "Our team costs $7 / hr": "vendor_pitch",
        "high-da backlinks for every page": "spam",
        "Dear winner, you have won a lamp": "spam",
        "The newsletter signup was a mistake": "mistake_entry",
        "please ignore this": "test_data",
    }
    for row, reason in zip(classify(spark, cases), cases.values()):
        assert row["disqualify_reasons"] == [reason]
        assert row["hard_disqualify"] and row["tags"] == [] and row["stage"] == "cold" and not row["notes_too_vague"]


def test_intent_tags_stage_and_profile(spark):
    cases = [
        ("Budget approved, keen to move fast. Want it automated end to end.",
         ["budget_approved", "urgency", "clear_pain_point"], "sales_ready", False, False, 26.0),
        ("very early startup, no real budget yet but sharp.", ["no_budget_yet"], "cold", False, False, 0.0),
        ("Comparing a  few options.", ["actively_comparing"], "warm", False, False, 2.0),
        ("Comparing a few options, but budget approved and ready to pilot in the next 2 weeks.",
         ["budget_approved", "urgency", "actively_comparing"], "sales_ready", False, False, 23.0),
        ("We're a SEO agency. Budget approved.", ["budget_approved"], "sales_ready", True, False, 14.0),
        ("SaaS company (not an agency). Budgeted, serious.", ["budgeted_serious"], "sales_ready", False, True, 12.0),
        ("An ecom brand agency.", [], "cold", True, False, 3.0),
        ("ecom brand", [], "cold", False, True, 3.0),
        ("Reached out on a Tuesday afternoon.", [], "cold", False, False, 3.0),
        ("", [], "cold", False, False, 3.0),
        (None, [], "cold", False, False, 3.0),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "source_row long, notes string")
    signals = notes.classify_notes(df).withColumn("points", notes.score_notes_intent(F.col("tags")))
    signals = signals.withColumn("stage_of_tags", notes.classify_engagement_stage(F.col("tags")))
    for row, (_, tags, stage, agency, adjacent, points) in zip(signals.orderBy("source_row").collect(), cases):
        got = (row["tags"], row["stage"], row["is_agency_icp"], row["is_adjacent_icp"], row["points"])
        assert got == (tags, stage, agency, adjacent, points)
        assert row["stage_of_tags"] == stage and row["notes_too_vague"] == (not tags) and not row["hard_disqualify"]


# --- scores ---------------------------------------------------------------------------------------------


def test_title_tiers(evaluate):
    cases = {
        "CEO": "decision_maker", "Founder": "decision_maker", "Managing Director": "decision_maker", "VP Growth": "influencer",
        "Head of Ops": "influencer", "Director of Ops": "influencer", "Student": "low_authority", "Intern CEO": "low_authority",
        "Internal CEO": "decision_maker", "Consultant": "other", "Cooper": "other", None: "unknown", "": "unknown",
    }
    got = evaluate(scoring.score_title, list(cases))
    assert [g["tier"] for g in got] == list(cases.values())
    points = {"decision_maker": 10.0, "influencer": 7.0, "low_authority": 0.0, "other": 4.0, "unknown": 4.0}
    assert [g["points"] for g in got] == [points[t] for t in cases.values()]


def test_employee_and_budget_points(evaluate):
    got = evaluate(lambda c: scoring.score_employees(c.cast("double")), [None, "1", "2.9", "3", "50", "100000"])
    assert got == [4.0, 2.0, 2.0, 10.0, 10.0, 10.0]
    values = [None, "0", "999", "1000", "3999", "4000", "7999.5", "8000", "100000"]
    got = evaluate(lambda c: scoring.score_stated_budget_intent(c.cast("double")), values)
    assert got == [2.0, 0.0, 0.0, 3.0, 3.0, 7.0, 7.0, 10.0, 10.0]


VERDICTS = [
    # notes, title, employees, budget, reachable -> fit, intent, stage, raw, bucket, hard
    ("small local business, not an agency, wants a cheap chatbot. budget way below range.", "Owner", 6.0, 500.0, True,
     30.0, 0.0, 0.0, 23.0, "Disqualify", False),
    ("We're a SEO agency, 43 people. This is eating our week. Want it automated end to end. Budget approved. "
     "This is my priority to solve.", "Director of Ops", 43.0, 7000.0, True, 37.0, 33.0, 20.0, 90.0, "Contact Now", False),
    ("We're a SEO agency, 9 people. Budget approved. This is my priority to solve. I make the call here.", "CEO", 9.0,
     18000.0, True, 40.0, 36.0, 20.0, 96.0, "Contact Now", False),
    ("SaaS company (not an agency). Budgeted, serious.", "Marketing Manager", 84.0, 6000.0, True, 24.0, 19.0, 20.0, 63.0,
     "Nurture", False),
    ("SaaS company (not an agency). Budgeted, serious.", "COO", None, 8000.0, True, 24.0, 22.0, 20.0, 66.0, "Contact Now", False),
    ("I'm a developer looking for a role.", "CEO", 500.0, 50000.0, True, 0.0, 0.0, 0.0, 0.0, "Disqualify", True),
    ("follow up later??", None, None, None, False, 0.0, 0.0, 0.0, 0.0, "Disqualify", True),
    ("broken email. one line: 'call me'.", None, None, None, True, 8.0, 5.0, 0.0, 13.0, "Disqualify", False),
    ("", "CEO", 50.0, 10000.0, True, 20.0, 13.0, 0.0, 33.0, "Disqualify", False),
    ("Comparing a few options. Budget not locked yet.", "Head of Ops", 15.0, 5000.0, True, 17.0, 6.0, 10.0, 33.0,
     "Disqualify", False),
]


def _leads(spark):
    data = [
        (i, n, t, e, b, "Ada" if reachable else None, None, None)
        for i, (n, t, e, b, reachable, *_) in enumerate(VERDICTS)
    ]
    schema = "source_row long, notes string, title string, employees double, monthly_budget double, name string, email string, company string"
    return spark.createDataFrame(data, schema)


def test_verdicts(spark):
    rows = scoring.qualify_leads(_leads(spark)).orderBy("source_row").collect()
    for row, (*_, fit, intent, stage, raw, bucket, hard) in zip(rows, VERDICTS):
        got = tuple(row[c] for c in ("fit_score", "intent_score", "engagement_score", "raw_score", "recommendation"))
        assert got == (fit, intent, stage, raw, bucket)
        assert row["hard_disqualify"] is hard and row["score"] == fit + intent + stage
    texts = [row["justification"] for row in rows]
    assert texts[5] == "Job seeker, not a buyer -- Disqualify."
    assert texts[6] == "No name, email, or company to act on -- Disqualify."
    assert texts[8] == (
        "Off-icp; notes are blank/too vague to assess intent, scored conservatively; cold -- Disqualify."
    )
    assert texts[9] == (
        "Off-icp with influencer authority; actively comparing options and budget not locked yet; warm -- Disqualify."
    )
    assert set(scoring.VERDICT_COLUMNS) <= set(rows[0].asDict())


def test_thresholds_change_the_bucket_but_not_the_score(spark):
    parts = scoring.score_parts(_leads(spark), notes_are_clean=False)
    default = scoring.add_verdict(parts).orderBy("source_row").collect()
    strict = scoring.add_verdict(parts, 201.0, 200.0).orderBy("source_row").collect()
    reversed_ = scoring.add_verdict(parts, 20.0, 60.0).orderBy("source_row").collect()
    assert {r["recommendation"] for r in strict} == {"Disqualify"}
    assert [r["score"] for r in strict] == [r["score"] for r in default]
    assert [r["recommendation"] for r in reversed_ if r["score"] >= 20] == ["Contact Now"] * 7


def test_threshold_sweep_counts_every_lead_once_per_pair(spark):
    parts = scoring.score_parts(_leads(spark), notes_are_clean=False)
    grid = [(65.0, 40.0), (20.0, 60.0), (-1.0, -2.0)]
    got = {(r[0], r[1]): tuple(r)[2:] for r in explore.threshold_sweep(parts, grid).collect()}
    assert got == {(65.0, 40.0): (3, 1, 6), (20.0, 60.0): (7, 0, 3), (-1.0, -2.0): (8, 0, 2)}


def test_filters(spark):
    schema = "recommendation string, score double, name string, company string, email string, title string"
    data = [("Nurture", 50.0, "Ada (X)", "", "a@b.c", "CEO"), ("Contact Now", 70.0, "", "Axis", "", ""), ("Nurture", 40.0, None, None, None, "x")]
    df = spark.createDataFrame(data, schema)

    def scores(**filters):
        return [r["score"] for r in explore.filter_leads(df, **filters).orderBy("score").collect()]

    assert scores() == [40.0, 50.0, 70.0] and scores(search="  ") == [40.0, 50.0, 70.0]
    assert scores(recommendations=["Nurture"]) == [40.0, 50.0] and scores(recommendations=[]) == []
    assert scores(score_range=(50.0, 70.0)) == [50.0, 70.0]
    assert scores(search=" (X") == [50.0] and scores(search="X") == [40.0, 50.0, 70.0]
    assert scores(search="^a.is$", regex=True) == [70.0]
    assert explore.filtered_counts(df, search="axis").first().asDict() == {"shown": 1, "total": 3}
    icons = [r["recommendation"][2:] for r in explore.with_icon(df).collect()]
    assert icons == ["Nurture", "Contact Now", "Nurture"]


def test_quantiles_of_values_with_many_ties(spark):
    rng = random.Random(5)
    data = [(rng.choice([8500.0, 8500.0, float(rng.randint(1, 900)), None]), float(rng.randint(1, 9))) for _ in range(3000)]
    got = profile(spark.createDataFrame(data, "a double, b double"), ("a", "b"), {"q1": 0.25, "median": 0.5, "q3": 0.75})
    for row in got.collect():
        values = sorted(v[0 if row["metric"] == "a" else 1] for v in data if v[0 if row["metric"] == "a" else 1] is not None)

        def at(q):
            position = (len(values) - 1) * q
            low = int(position)
            return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (position - low)

        assert (row["n"], row["min"], row["max"]) == (len(values), values[0], values[-1])
        assert (row["q1"], row["median"], row["q3"]) == pytest.approx((at(0.25), at(0.5), at(0.75)))
    assert got.count() == 2


def test_queries_keep_generated_methods_short_enough_to_compile(spark):
    from leadlane.plans.catalogue import QUERIES
    from leadlane.plans.job import SESSION_SETTINGS, compile_methods

    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    try:
        spark.conf.unset(key)
        QUERIES["clean_text_fields"](spark, "/root/testdata/sf0.001")
        assert spark.conf.get(key) == SESSION_SETTINGS[key]
        spark.conf.set(key, "9000")
        compile_methods(spark)
        assert spark.conf.get(key) == "9000"
    finally:
        spark.conf.set(key, before)
