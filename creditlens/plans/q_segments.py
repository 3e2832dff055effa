"""Registered segment and trend queries: the nine questions and the summary.

Each question is described once by its groups, measures, filter, group-size floor and
order; the DuckDB text is built from the description, with bounds and labels taken from
``functions.recode``. The Spark side is ``operators.segments``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from ..functions import recode
from ..operators import segments as seg
from ..sources.files import register_table
from ..sources.fixtures import oracle_views
from . import inputs
from .registry import query

VIEWS = oracle_views(("loans",)).rstrip() + ",\nsql_loans AS (SELECT *, year(issue_date) AS issue_year FROM loans)"

MILLIONS, PERCENT = "/ 1000000.0", "* 100"


def rounded(call: str, digits: int, scale: str = "") -> str:
    return f"ROUND({call} {scale}, {digits})"


def mean(column: str, digits: int = 0) -> str:
    return rounded(f"AVG({column})", digits)


def rate(digits: int = 2) -> str:
    return rounded("AVG(target)", digits, PERCENT)


ROWS, DEFAULTS, VOLUME = "COUNT(*)", "SUM(target)", rounded("SUM(loan_amnt)", 1, MILLIONS)


def ladder(column: str, bounds: Sequence[float], labels: Sequence[str]) -> str:
    """The label of the first bound that the column is under, else the last label."""
    steps = " ".join(f"WHEN {column} < {b} THEN '{name}'" for b, name in zip(bounds, labels))
    return f"CASE {steps} ELSE '{labels[-1]}' END"


def at_least(value: str, steps: Sequence[tuple[float, str]], otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {value} >= {least} THEN '{name}'" for least, name in steps) + f" ELSE '{otherwise}' END"


@dataclass
class Question:
    """``groups`` and ``measures`` map result columns to expressions."""

    measures: dict[str, str]
    groups: dict[str, str] = field(default_factory=dict)
    where: str = ""
    floor: int = 0
    order: str = ""
    top: int = 0
    table: str = "sql_loans"

    def select(self) -> str:
        parts = ["SELECT " + ", ".join(f"{e} AS {name}" for name, e in (self.groups | self.measures).items()), f"FROM {self.table}"]
        parts += [f"WHERE {self.where}"] if self.where else []
        parts += [f"GROUP BY {', '.join(self.groups.values())}"] if self.groups else []
        parts += [f"HAVING COUNT(*) >= {self.floor}"] if self.floor else []
        parts += [f"ORDER BY {self.order}"] if self.order else []
        return " ".join(parts + ([f"LIMIT {self.top}"] if self.top else []))

    def oracle(self) -> str:
        return f"{VIEWS}\n{self.select()}"


SUMMARY = Question({"total_loans": ROWS, "total_defaults": DEFAULTS, "default_rate_pct": rate(), "avg_loan_amount": mean("loan_amnt"),
                    "avg_annual_income": mean("annual_inc"), "avg_interest_rate": mean("int_rate", 2), "avg_dti": mean("dti", 2)})
GRADE = Question({"total_loans": ROWS, "defaults": DEFAULTS, "default_rate_pct": rate(), "avg_interest_rate": mean("int_rate", 2),
                  "avg_loan_amount": mean("loan_amnt"), "avg_annual_income": mean("annual_inc")}, {"grade": "grade"}, "grade IS NOT NULL", order="grade")
STATE = {"groups": {"state": "addr_state"}, "where": "addr_state IS NOT NULL", "floor": inputs.FLOORS["state"], "top": 10}
STATE_VOLUME = Question({"total_loans": ROWS, "defaults": DEFAULTS, "default_rate_pct": rate(), "total_loan_volume_M": VOLUME}, order="total_loans DESC, state", **STATE)
STATE_RATE = Question({"default_rate_pct": rate()}, order="default_rate_pct DESC, state", **STATE)
PURPOSE = Question({"total_loans": ROWS, "default_rate_pct": rate(), "avg_loan_amount": mean("loan_amnt"),
                    "risk_category": at_least("AVG(target)", recode.RISK_LABELS, recode.RISK_ELSE)}, {"purpose": "purpose"}, "purpose IS NOT NULL", order="default_rate_pct DESC")
YEAR = Question({"total_loans": ROWS, "defaults": DEFAULTS, "default_rate_pct": rate(), "avg_loan_amount": mean("loan_amnt"), "total_volume_M": VOLUME},
                {"year": "issue_year"}, "issue_year IS NOT NULL", order="year")
INCOME = Question({"total_loans": ROWS, "default_rate_pct": rate(), "avg_loan_amount": mean("loan_amnt"), "avg_dti": mean("dti", 2)},
                  {"income_bracket": ladder("annual_inc", recode.INCOME_BOUNDS, recode.INCOME_LABELS)}, order="income_bracket")
DTI = Question({"loan_count": ROWS, "default_rate_pct": rate(), "avg_income": mean("annual_inc"), "avg_loan_amount": mean("loan_amnt")},
               {"dti_bucket": ladder("dti", recode.DTI_BOUNDS, recode.DTI_LABELS)}, "dti >= 0", inputs.FLOORS["dti"], "dti_bucket")
CELLS = Question({"loan_count": ROWS, "default_rate_pct": rate(1)}, {"grade": "grade", "purpose": "purpose"}, floor=inputs.FLOORS["grade_purpose"],
                 order="default_rate_pct DESC, loan_count DESC, grade NULLS FIRST, purpose NULLS FIRST", top=15)
ISSUED = Question({"loans_issued": ROWS, "volume_M": VOLUME}, {"year": "issue_year"}, "issue_year IS NOT NULL")
PROFILE = {"loan_count": ROWS, "default_rate_pct": rate(), "avg_loan_amount": mean("loan_amnt"), "avg_annual_income": mean("annual_inc"),
           "avg_interest_rate": mean("int_rate", 2), "avg_dti": mean("dti", 2)}
#: The segments' names are fixed result values; their predicates are those of ``seg.default_segments``.
SEGMENTS = dict(zip(seg.default_segments_names(), ("grade IN ('D', 'E', 'F', 'G') AND dti > 25", "grade IN ('A', 'B') AND dti <= 20", "")))

RUNNING = f"""{VIEWS}, y AS ({ISSUED.select()})
SELECT *, SUM(loans_issued) OVER upto AS running_total_loans, ROUND(SUM(volume_M) OVER upto, 1) AS running_volume_M FROM y WINDOW upto AS (ORDER BY year)"""
UNION = VIEWS + "\n" + "\nUNION ALL ".join(Question({"segment": f"'{name}'", **PROFILE}, where=test).select() for name, test in SEGMENTS.items())
MATRIX = f"""{VIEWS}, cells AS ({Question({"r": rate(1)}, CELLS.groups, "purpose IS NOT NULL", CELLS.floor).select()})
SELECT purpose, {", ".join(f"ANY_VALUE(r) FILTER (grade = '{g}') AS {g}" for g in seg.GRADES)} FROM cells GROUP BY purpose"""


@query("portfolio_summary", oracle=SUMMARY.oracle())
def portfolio_summary(spark, sf_dir):
    return seg.portfolio_summary(inputs.loans_sql(spark, sf_dir))


@query("q1_grade", oracle=GRADE.oracle())
def q1_grade(spark, sf_dir):
    return seg.risk_by_grade(inputs.loans_sql(spark, sf_dir))


@query("q1_grade_sql_text", oracle=GRADE.oracle())
def q1_grade_sql_text(spark, sf_dir):
    """The same question as SQL text over a table registered by name."""
    register_table(inputs.loans_sql(spark, sf_dir), "sql_loans")
    return seg.run_sql(spark, GRADE.select())


@query("q2_states_by_volume", oracle=STATE_VOLUME.oracle())
def q2_states_by_volume(spark, sf_dir):
    return seg.states_by_volume(inputs.loans_sql(spark, sf_dir), inputs.FLOORS["state"])


@query("q2b_states_by_rate", oracle=STATE_RATE.oracle())
def q2b_states_by_rate(spark, sf_dir):
    return seg.states_by_default_rate(inputs.loans_sql(spark, sf_dir), inputs.FLOORS["state"])


@query("q3_purpose_risk", oracle=PURPOSE.oracle())
def q3_purpose_risk(spark, sf_dir):
    return seg.purpose_risk(inputs.loans_sql(spark, sf_dir))


@query("q4_yearly_trend", oracle=YEAR.oracle())
def q4_yearly_trend(spark, sf_dir):
    return seg.yearly_trend(inputs.loans_sql(spark, sf_dir))


@query("q5_income_brackets", oracle=INCOME.oracle())
def q5_income_brackets(spark, sf_dir):
    return seg.income_brackets(inputs.loans_sql(spark, sf_dir))


@query("q6_running_totals", oracle=RUNNING)
def q6_running_totals(spark, sf_dir):
    return seg.running_totals(inputs.loans_sql(spark, sf_dir))


@query("q7_segment_profile", oracle=UNION)
def q7_segment_profile(spark, sf_dir):
    return seg.segment_profile(inputs.loans_sql(spark, sf_dir))


@query("q7_segment_union", oracle=UNION)
def q7_segment_union(spark, sf_dir):
    return seg.segment_union(inputs.loans_sql(spark, sf_dir))


@query("q8_dti_buckets", oracle=DTI.oracle())
def q8_dti_buckets(spark, sf_dir):
    return seg.dti_buckets(inputs.loans_sql(spark, sf_dir), inputs.FLOORS["dti"])


@query("q8_dti_tiers", oracle="SELECT *, CASE WHEN default_rate_pct < 18 THEN 'low' WHEN default_rate_pct < 22 THEN 'medium' ELSE 'high' END AS tier FROM ("
       + DTI.oracle() + ")")
def q8_dti_tiers(spark, sf_dir):
    """The buckets' default rates in tiers below 18, below 22 and above."""
    return seg.dti_buckets(inputs.loans_sql(spark, sf_dir), inputs.FLOORS["dti"]).withColumn("tier", recode.three_tier("default_rate_pct", 18, 22))


@query("q9_grade_purpose_top", oracle=CELLS.oracle())
def q9_grade_purpose_top(spark, sf_dir):
    return seg.grade_purpose_top(inputs.loans_sql(spark, sf_dir), inputs.FLOORS["grade_purpose"])


@query("q9_grade_purpose_matrix", oracle=MATRIX)
def q9_grade_purpose_matrix(spark, sf_dir):
    return seg.grade_purpose_matrix(inputs.loans_sql(spark, sf_dir), inputs.FLOORS["grade_purpose"])
