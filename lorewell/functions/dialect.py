"""Scalar building blocks of the SQL plans, each with one meaning in Spark SQL and in the SQL that checks it.

A plan is written once as a function of a dialect.  Spark runs it through Catalyst; the other rendering is what an
independent engine runs over the same tables.
"""

from __future__ import annotations

WS = r"[ \t\n\r\f\x0B]+"


class Spark:
    """Renders for Spark SQL; string literals keep their backslashes (raw)."""

    name = "spark"

    @staticmethod
    def text(s: str) -> str:
        return "r'" + s.replace("'", "''") + "'" if "'" not in s else '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'

    def replace_all(self, x, pattern, to):
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(to)})"

    def split(self, x, pattern):
        return f"split({x}, {self.text(pattern)})"

    def matches(self, x, pattern):
        return f"regexp_extract_all({x}, {self.text(pattern)}, 0)"

    def rlike(self, x, pattern):
        return f"rlike({x}, {self.text(pattern)})"

    def filter(self, x, var, cond):
        return f"filter({x}, {var} -> {cond})"

    def map(self, x, var, e):
        return f"transform({x}, {var} -> {e})"

    def distinct(self, x):
        return f"array_distinct({x})"

    def size(self, x):
        return f"CAST(size({x}) AS BIGINT)"

    def both(self, a, b):
        return f"array_intersect({a}, {b})"

    def union(self, a, b):
        return f"array_union({a}, {b})"

    def sort(self, x):
        return f"array_sort({x})"

    def first(self, x, n):
        return f"slice({x}, 1, {n})"

    def join(self, x, sep):
        return f"array_join({x}, '{sep}')"

    def explode(self, x):
        return f"explode({x})"

    def list(self, *x):
        return f"array({', '.join(x)})"

    def at(self, x, i):
        return f"get({x}, {i} - 1)"

    def contains(self, a, b):
        return f"contains({a}, {b})"

    def length(self, x):
        return f"CAST(length({x}) AS BIGINT)"

    def seconds(self, a, b):
        """Seconds from a to b."""
        return f"CAST(timestampdiff(SECOND, {a}, {b}) AS BIGINT)"

    def collect(self, x, order):
        return f"transform(array_sort(collect_list(struct({order} AS o, {x} AS x))), s -> s.x)"

    def collect_set(self, x):
        return f"array_sort(collect_set({x}))"

    def max_by(self, x, o):
        return f"max_by({x}, {o})"

    def min_by(self, x, o):
        return f"min_by({x}, {o})"

    def range(self, a, b, step="1"):
        """a, a + step, ... up to b; b is at least a."""
        return f"sequence({a}, {b}, {step})"

    def total(self, x, var, e):
        return f"aggregate({x}, CAST(0 AS DOUBLE), (acc, {var}) -> acc + {e})"

    def has(self, x, e):
        return f"array_contains({x}, {e})"

    def idiv(self, a, b):
        return f"({a} div {b})"

    def json_int(self, x, key):
        return f"CAST(get_json_object({x}, '$.{key}') AS BIGINT)"


class Duck(Spark):
    """Renders for the checking engine."""

    name = "duck"

    @staticmethod
    def text(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def replace_all(self, x, pattern, to):
        return f"regexp_replace({x}, {self.text(pattern)}, {self.text(to.replace('$', chr(92)))}, 'g')"

    def split(self, x, pattern):
        return f"regexp_split_to_array({x}, {self.text(pattern)})"

    def matches(self, x, pattern):
        return f"regexp_extract_all({x}, {self.text(pattern)})"

    def rlike(self, x, pattern):
        return f"regexp_matches({x}, {self.text(pattern)})"

    def filter(self, x, var, cond):
        return f"list_filter({x}, lambda {var}: {cond})"

    def map(self, x, var, e):
        return f"list_transform({x}, lambda {var}: {e})"

    def distinct(self, x):
        return f"list_distinct({x})"

    def size(self, x):
        return f"len({x})"

    def both(self, a, b):
        return f"list_intersect({a}, {b})"

    def union(self, a, b):
        return f"list_distinct(list_concat({a}, {b}))"

    def sort(self, x):
        return f"list_sort({x})"

    def first(self, x, n):
        return f"list_slice({x}, 1, {n})"

    def join(self, x, sep):
        return f"array_to_string({x}, '{sep}')"

    def explode(self, x):
        return f"unnest({x})"

    def list(self, *x):
        return f"[{', '.join(x)}]"

    def at(self, x, i):
        return f"list_extract({x}, {i})"

    def length(self, x):
        return f"length({x})"

    def seconds(self, a, b):
        return f"CAST(floor(epoch({b}) - epoch({a})) AS BIGINT)"

    def collect(self, x, order):
        return f"list({x} ORDER BY {order})"

    def collect_set(self, x):
        return f"list_sort(list(DISTINCT {x}))"

    def max_by(self, x, o):
        return f"arg_max({x}, {o})"

    def min_by(self, x, o):
        return f"arg_min({x}, {o})"

    def range(self, a, b, step="1"):
        return f"generate_series({a}, {b}, {step})"

    def total(self, x, var, e):
        return f"coalesce(list_sum(list_transform({x}, lambda {var}: CAST({e} AS DOUBLE))), 0.0)"

    def has(self, x, e):
        return f"list_contains({x}, {e})"

    def idiv(self, a, b):
        return f"({a} // {b})"

    def json_int(self, x, key):
        return f"CAST(json_extract_string({x}, '$.{key}') AS BIGINT)"


def normalised(d, x):
    """Lower case, runs of white space as one space, none at the ends."""
    return f"trim({d.replace_all(f'lower({x})', WS, ' ')})"


def tokens(d, x):
    """Distinct white-space tokens."""
    return d.distinct(d.filter(f"{d.split(normalised(d, x), ' ')}", "t", "t <> ''"))


def alnum_tokens(d, x):
    """Distinct ASCII alphanumeric tokens of three characters or more."""
    return d.distinct(d.filter(d.split(f"lower({x})", "[^a-z0-9]+"), "t", "length(t) >= 3"))


def word_tokens(d, x):
    """Distinct tokens of letters, digits and underscores of any script."""
    return d.distinct(d.filter(d.split(f"lower({x})", r"[^\p{L}\p{N}_]+"), "t", "t <> ''"))


def token_estimate(d, x):
    """A token for every four characters, one at least; none for an empty text."""
    return f"CASE WHEN {x} IS NULL OR {x} = '' THEN 0 ELSE greatest(1, {d.idiv(f'({d.length(x)} + 3)', '4')}) END"


def any_of(d, x, words):
    """Whether a text contains one of some strings."""
    return "(" + " OR ".join(d.contains(x, f"'{w}'") for w in words) + ")"


def in_list(words):
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"
