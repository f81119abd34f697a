"""All sentences and chart titles of a report, as templates over the numbers behind them."""

from __future__ import annotations

TEXT = {
    "overview": "{rows:,} rows in {columns} columns: {measures} measures, {dimensions} groupings. Blank cells: {missing:.1f}%.",
    "complete": "Every column is filled in every row.",
    "gaps": "Blank cells occur in {columns} of the columns, most of all in {worst} ({share:.1f}% blank).",
    "leaders": "Ranked by {measure}, the first {entity} values are {names}.",
    "leaders_gap": "What sets those {entity} apart is {metric}: {leaders:.2f} on average, against {rest:.2f} for the others.",
    "gap": "{actual} is above {expected} in {over} rows and below it in {under}; on average the difference is {mean:+.2f}.",
    "gap_by": "By {segment}, {actual} minus {expected} runs from {worst:+.2f} ({last}) to {best:+.2f} ({first}).",
    "across": "Split by {dim}, {a} is highest in {lead} at {value:.1f}, which is {ratio:.2f} times its {b}{part}.",
    "across_part": "; {shown} of {groups} groups are drawn",
    "pair": "{a} and {b} have a {strength} {sign} relation, r = {r:.2f}.",
    "segment": "{how} {measure} by {dim}{part} goes from {worst:.2f} ({last}) to {best:.2f} ({first}), {spread:.0f}% of the middle.",
    "segment_part": " ({groups} groups)",
    "two_way": "The highest {how} {measure} of all pairs, {value:.2f}, belongs to {first} of {d1} with {second} of {d2}.",
    "cohort": "Between the upper and the lower quarter by {measure}, {metric} differs most: {top:.2f} and {bottom:.2f}.",
    "crosstab": "{d2} is not spread the same way in all groups of {d1}.",
    "category": "{k} values of {dim} occur; {value} makes up {share:.0f}% of the rows{heavy}.",
    "category_heavy": ", so it outweighs all others",
    "distribution": "{name} lies between {low:.2f} and {high:.2f}, mean {mean:.2f}, median {median:.2f}; {shape}.",
    "trend": "From the first period to the last, mean {measure} {direction} ({pct:+.0f}%).",
    "outliers": "{count} values of {name} ({share:.1f}%) lie outside {low:.2f} to {high:.2f}, one and a half quartile ranges from the quartiles.",
    "scope": "{lead}{kept:,} rows of {total:,} are used, those with {column} in {labels}.",
}
TITLE = {
    "gaps": "Blank cells per column, percent", "leaders": "{entity}: first ten by {measure}", "gap": "{actual} against {expected}",
    "gap_by": "{actual} less {expected}, by {segment}", "pair": "{b} against {a}", "across": "{a} and {b} per {dim}{part}",
    "segment": "{how} {measure} per {dim}{part}", "part": ", first {shown}", "two_way": "{how} {measure} per {d1} and {d2}",
    "cohort": "Upper and lower quarter by {measure}", "crosstab": "{d2} within {d1}", "category": "Rows per {dim}",
    "distribution": "Values of {name}", "trend": "{measure} by period",
}
SHAPES = {1: "a few large values stretch it upward", -1: "a few small values stretch it downward", 0: "both sides look alike"}
DIRECTIONS = {"up": "rose", "down": "fell", "flat": "hardly changed"}
MEANING = {"sum": "total", "mean": "mean"}


def say(key: str, **values) -> str:
    return TEXT[key].format(**values)


def title(key: str, **values) -> str:
    return TITLE[key].format(**values)
