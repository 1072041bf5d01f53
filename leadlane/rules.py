"""Rule tables and constants of the lead model."""

# ---------------------------------------------------------------------------
# Fixed values. Everything in this module has to stay exactly as it is for the
# results to be right; it is data, not logic. Patterns are matched anywhere in
# the lower-cased notes with whitespace runs collapsed to one space.
# ---------------------------------------------------------------------------

COLUMNS = (
    "lead_id", "created", "name", "email", "company",
    "employees", "website", "title", "source", "monthly_budget", "notes",
)

RANKED_COLUMNS = (
    "lead_id", "created", "name", "email", "email_valid", "company", "website",
    "employees", "title", "source", "monthly_budget", "notes",
    "fit_score", "intent_score", "engagement_score", "score", "engagement_stage",
    "recommendation", "justification",
)

EXCLUDED_COLUMNS = ("source_row", "lead_id", "reason", "detail", "notes")

# Counts of a run, as printed.
SUMMARY_LABELS = {
    "total_rows_read": "Rows in",
    "junk_rows_dropped": "Left out as junk",
    "duplicate_rows_dropped": "Left out as duplicates",
    "qualified_rows": "Leads ranked",
}

# Texts that mean "no answer" in any cell.
BLANK_TOKENS = ("", "nan", "none", "null", "n/a", "na", "-", "?")

# Junk rows: reason code -> audit detail, and the markers of each kind.
BLANK_ROW = "blank_row"
HEADER_ROW = "embedded_header_row"
TEST_ROW = "test_placeholder_row"
DUPLICATE = "duplicate_submission"
JUNK_DETAILS = {
    BLANK_ROW: "Row has no data in any column.",
    HEADER_ROW: "A stray header row leaked into the data.",
    TEST_ROW: "QA/placeholder row, not a real lead.",
}
REASONS = (BLANK_ROW, HEADER_ROW, TEST_ROW, DUPLICATE)
HEADER_IDS = ("header", "lead_id")
TEST_IDS = ("testrow", "test")
TEST_NOTE_MARKERS = ("qa test entry", "test test ignore", "please ignore")
TEST_FIELDS = ("name", "company", "title", "source")
TEST_WORD_LENGTH = 6

# Deduplication.
DUPLICATE_MARKER = "(duplicate submission)"
COMPLETENESS_FIELDS = (
    "name", "email", "company", "employees", "website", "title", "source", "monthly_budget",
)

# Hard disqualifiers: (reason, pattern, label), in order.
HARD_DISQUALIFIERS = (
    ("job_seeker", r"looking for a role|attaching (my )?cv|are you hiring|join your team",
     "job seeker, not a buyer"),
    ("investor_not_buyer", r"\bvc here\b|portfolio compan|not a direct buyer",
     "investor/VC, not a direct buyer"),
    ("student_researcher",
     r"\bcs student\b|final year student|university project|bootcamp grad|how you built your systems",
     "student/academic research, not a client"),
    ("press_inquiry", r"\bjournalist\b|looking for a quote", "press inquiry, not a client"),
    ("competitor",
     r"competing automation agency|fellow agency owner|researching the market|do similar work|pricing for benchmarking",
     "competitor researching the market"),
    ("recruiter_pitch", r"automation devs on our bench|place candidates",
     "recruiter pitching candidates (not a lead)"),
    ("vendor_pitch", r"offshore dev team|bulk email blasting|\$\d+\s*/\s*hr\b",
     "vendor pitching us a service (not a lead)"),
    ("spam", r"smm panel|buy followers|high-da backlinks|reply stop|you have won|click here to claim",
     "spam / scam submission"),
    ("mistake_entry", r"newsletter signup.*mistake", "submitted by mistake (newsletter signup)"),
    ("test_data", r"qa test entry|ignore this", "QA/test placeholder row"),
)
NO_CONTACT_REASON = "insufficient_contact_data"
NO_CONTACT_LABEL = "no name, email, or company to act on"

SALES_READY = "sales_ready"
WARM = "warm"
COLD = "cold"

# Intent lexicon: (tag, weight, stage, pattern, label), in order.
INTENT_SIGNALS = (
    ("budget_approved", 14.0, SALES_READY, r"budget approved", "budget approved"),
    ("budgeted_serious", 12.0, SALES_READY, r"budgeted,?\s*serious", "budgeted and serious"),
    ("urgency", 7.0, SALES_READY,
     r"wants to start asap|keen to move fast|ready to pilot in the next 2 weeks|this is my priority to solve|"
     r"decision this month|wants to move in 2 weeks|priority for the quarter",
     "urgency to start"),
    ("confirmed_authority", 5.0, SALES_READY, r"i make the call here|decision is mine",
     "confirmed decision-making authority"),
    ("clear_pain_point", 5.0, WARM, r"eating our week|want it automated end to end",
     "a clear, specific pain point"),
    ("real_budget", 6.0, WARM, r"(?<!no )\breal budget\b", "a real budget confirmed"),
    ("money_to_spend", 4.0, WARM, r"money to spend", "money to spend"),
    ("some_budget", 3.0, WARM, r"have some budget", "some budget"),
    ("actively_comparing", 2.0, WARM, r"comparing a few options", "actively comparing options"),
    ("scope_unclear", -3.0, WARM, r"not totally sure what we need yet|interested but vague on scope",
     "scope not yet defined"),
    ("price_sensitive", -3.0, WARM, r"price sensitive", "price sensitivity"),
    ("budget_not_locked", -3.0, WARM, r"budget not locked yet", "budget not locked yet"),
    ("needs_internal_buyin", -3.0, WARM, r"would need to loop in the team", "a need for internal buy-in"),
    ("authority_unclear", -4.0, WARM, r"not sure who signs off internally",
     "no decision-maker identified yet"),
    ("budget_withheld", -3.0, WARM, r"wont share budget yet|won.?t share budget|depends what you can do",
     "budget undisclosed"),
    ("no_budget_yet", -4.0, COLD, r"no real budget yet", "no budget yet (early-stage)"),
    ("tiny_budget", -4.0, COLD, r"tiny budget|one-man shop", "a very small budget"),
    ("budget_below_range", -7.0, COLD, r"budget way below range", "a budget well below our range"),
    ("cannot_pay_now", -6.0, COLD, r"can.?t really pay right now", "an inability to pay right now"),
)

# Customer-profile patterns.
NOT_AGENCY_PATTERN = r"not an agency"
AGENCY_PATTERN = r"\bagency\b"
ADJACENT_PATTERN = r"saas company|ecom brand"

# Title keywords, matched as whole words; the tiers are tried in this order.
TITLE_TIERS = (
    ("low_authority", 0.0, ("student", "freelancer", "developer", "recruiter", "intern")),
    ("decision_maker", 10.0, ("ceo", "cto", "coo", "founder", "owner", "managing director",
                              "managing partner", "president", "partner")),
    ("influencer", 7.0, ("vp", "head of", "director")),
)
TITLE_OTHER_POINTS = 4.0
TITLE_UNKNOWN_POINTS = 4.0
TITLE_PHRASES = {
    "decision_maker": "decision-maker authority",
    "influencer": "influencer authority",
    "low_authority": "low authority",
}

# Points and bands.
EMPLOYEES_UNKNOWN_POINTS = 4.0
EMPLOYEES_FLOOR = 3.0
EMPLOYEES_FIT_POINTS = 10.0
EMPLOYEES_SMALL_POINTS = 2.0
AGENCY_POINTS = 20.0
ADJACENT_POINTS = 10.0
BUDGET_BANDS = ((8000.0, 10.0), (4000.0, 7.0), (1000.0, 3.0), (0.0, 0.0))
BUDGET_UNKNOWN_POINTS = 2.0
NO_SIGNAL_POINTS = 3.0
NOTES_BAND = 30.0
FIT_BAND = 40.0
INTENT_BAND = 40.0
STAGE_POINTS = {SALES_READY: 20.0, WARM: 10.0, COLD: 0.0}
STAGE_LABELS = {SALES_READY: "Sales-Ready", WARM: "Warm", COLD: "Cold"}

# Buckets.
CONTACT_NOW = "Contact Now"
NURTURE = "Nurture"
DISQUALIFY = "Disqualify"
BUCKETS = (CONTACT_NOW, NURTURE, DISQUALIFY)
BUCKET_ICONS = {CONTACT_NOW: "\U0001F7E2", NURTURE: "\U0001F7E1", DISQUALIFY: "\U0001F534"}
CONTACT_NOW_THRESHOLD = 65.0
NURTURE_THRESHOLD = 40.0

# Pieces of the justification sentence.
AGENCY_LABEL = "agency ICP fit"
ADJACENT_LABEL = "adjacent-market fit"
OFF_ICP_LABEL = "off-ICP"
VAGUE_CLAUSE = "notes are blank/too vague to assess intent, scored conservatively"
NO_SIGNAL_CLAUSE = "no strong signals in the notes"

# Customer-profile analyses: tags of the strongest-signal cohort and the pain points looked for in its notes.
COHORT_COMMITMENT_TAGS = ("budget_approved", "budgeted_serious")
COHORT_URGENCY_TAG = "urgency"
PAIN_POINTS = (
    ("eating our week", r"eating our week"),
    ("want it automated end to end", r"want it automated end to end"),
    ("enriching and scoring leads one by one", r"leads one by one"),
    ("moving leads between tools by hand", r"moving leads between"),
    ("drafting first-touch messages", r"first-touch messages"),
    ("manual lead routing", r"lead routing"),
    ("pacing ad budgets across accounts", r"pacing ad budgets"),
    ("chasing follow-ups", r"chasing follow-ups"),
    ("triaging a shared inbox", r"shared inbox"),
    ("qualifying inbound leads", r"qualifying inbound"),
    ("building client reports across tools", r"client reports"),
    ("summarizing call recordings", r"call recordings"),
)
