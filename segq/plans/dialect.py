"""One relational text, two engines.

An operator is a function of a dialect that returns a SELECT; ``Spark`` is
what runs on the cluster (Catalyst plans it like any DataFrame), ``Duck``
renders the same relation for differential tests.  Only names of functions,
string escapes and lambdas differ between the two.
"""

from __future__ import annotations

import re


class Spark:
    name = "spark"
    sha = staticmethod(lambda x: f"sha2({x}, 256)")
    size = staticmethod(lambda a: f"size({a})")
    distinct = staticmethod(lambda a: f"array_distinct({a})")
    has_item = staticmethod(lambda a, x: f"array_contains({a}, {x})")
    join = staticmethod(lambda a, sep: f"array_join({a}, '{sep}')")
    sort = staticmethod(lambda a: f"array_sort({a})")
    minus = staticmethod(lambda a, b: f"array_except({a}, {b})")
    explode = staticmethod(lambda a: f"explode({a})")
    most = staticmethod(lambda a: f"array_max({a})")
    posexplode = staticmethod(lambda a: f"posexplode({a}) AS (pos, x)")
    starts = staticmethod(lambda a, b: f"startswith({a}, {b})")
    ends = staticmethod(lambda a, b: f"endswith({a}, {b})")
    array = staticmethod(lambda *x: f"array({', '.join(x)})")
    last_known = staticmethod(lambda x, over: f"last_value({x}) IGNORE NULLS OVER ({over})")
    joined = staticmethod(lambda x, sep=",": f"array_join(array_sort(collect_list({x})), '{sep}')")
    joined_set = staticmethod(lambda x, sep=",": f"array_join(array_sort(collect_set({x})), '{sep}')")
    joined_by = staticmethod(lambda x, by, sep: f"array_join(transform(array_sort(collect_list(CASE WHEN ({x}) IS NOT NULL THEN struct({by} AS k, {x} AS v) END)), y -> y.v), '{sep}')")
    item = staticmethod(lambda a, i: f"get({a}, {i} - 1)")
    chars = staticmethod(lambda s: f"length({s})")
    json = staticmethod(lambda c, key: f"get_json_object({c}, '$.{key}')")
    #: Rows where the test holds; null, as in DuckDB, where it is known for no row.
    count_if = staticmethod(lambda test: f"sum(CASE WHEN {test} THEN 1 WHEN NOT ({test}) THEN 0 END)")

    #: Hash of an expression that is never null; Spark takes sha2 for nullable
    #: and would compute it once more to filter a join key.
    key = staticmethod(lambda x: f"coalesce(sha2({x}, 256), '')")

    @staticmethod
    def rx(p: str) -> str:
        return "r'" + p + "'"

    def n(self, col: str, p: str) -> str:
        return f"regexp_count({col}, {self.rx(p)})"

    def n_any(self, col: str, words) -> str:
        """Occurrences of the words; where all are of letters alone, a place is
        first looked at by the letters that words begin with."""
        if not words or not all(w.isalpha() for w in words):
            return self.n(col, "|".join(words))
        ahead = "".join(f"[{''.join(sorted(set(column)))}]" for column in zip(*words))
        return self.n(col, f"(?={ahead})(?:{'|'.join(words)})")

    def n_of(self, col: str, p: str, marks) -> str:
        """Occurrences of plain marks, none of which overlaps another; ``p`` is
        the pattern of them all."""
        return " + ".join(f"CAST((length({col}) - length(replace({col}, '{m}', ''))) / {len(m)} AS INT)" for m in marks)

    def has(self, col: str, p: str) -> str:
        return f"({col} RLIKE {self.rx(p)})"

    def ext(self, col: str, p: str, group: int = 1) -> str:
        return f"regexp_extract({col}, {self.rx(p)}, {group})"

    def ext_of(self, col: str, pattern: str, group: int) -> str:
        """Group of the first match of a pattern that is a column."""
        return f"regexp_extract({col}, {pattern}, {group})"

    def by_length(self, a: str) -> str:
        """Items by length, longest first, then in order."""
        return f"transform(array_sort(transform({a}, x -> struct(-length(x) AS n, x AS x))), y -> y.x)"

    def heads(self, a: str) -> str:
        """Distinct beginnings of the items, of one to four characters."""
        return f"array_distinct(flatten(transform({a}, x -> transform(sequence(1, least(4, length(x))), i -> substring(x, 1, i)))))"

    def all(self, col: str, p: str) -> str:
        return f"regexp_extract_all({col}, {self.rx(p)}, 0)"

    def sub(self, col: str, p: str, put: str = "") -> str:
        return f"regexp_replace({col}, {self.rx(p)}, '{put}')"

    def filter(self, a: str, cond: str) -> str:
        return f"filter({a}, x -> {cond})"

    def map(self, a: str, expr: str) -> str:
        return f"transform({a}, x -> {expr})"

    def differ(self, a: str, b: str, test) -> str:
        """Whether ``test(x, y)`` holds for a pair of items at one place."""
        return f"coalesce(exists(zip_with({a}, {b}, (x, y) -> {test('x', 'y')}), z -> z), false)"

    def split(self, col: str, sep: str) -> str:
        return f"split({col}, {self.rx(re.escape(sep))})"

    def settled(self, query: str) -> str:
        """The query's rows through a one-row generator.  Conditions over its
        columns are not pushed below it, where each column would be written
        out again as often as it is used, nested to great size."""
        return f"SELECT v.* FROM (SELECT struct(q.*) AS whole_row FROM ({query}) q) w LATERAL VIEW inline(array(whole_row)) v"

    # shared by both
    def norm(self, col: str) -> str:
        """Canonical text: lower, trimmed, white space squeezed; null is ''."""
        return f"lower(trim({self.sub(f"coalesce({col}, '')", '[ \\t\\n\\x0b\\f\\r]+', ' ')}))"

    def tokens(self, col: str) -> str:
        return self.all(f"lower(coalesce({col}, ''))", r"[\p{L}\p{N}]{2,}")

    def words(self, col: str) -> str:
        return self.all(f"coalesce({col}, '')", r"[^ \t\n\x0b\f\r]+")

    def among(self, col: str, words) -> str:
        """How many tokens of ``col`` are in the word list."""
        return self.size(self.filter(self.tokens(col), f"x IN ({', '.join(repr(w) for w in words)})"))

    def padded(self, text: str) -> str:
        """Tokens of the text, lower case, between single spaces: a phrase with
        boundaries is then a plain substring."""
        return f"(' ' || trim({self.sub(f"lower(coalesce({text}, ''))", r"[^\p{L}\p{N}_]+", ' ')}) || ' ')"

    def whole_word(self, text: str, term: str) -> str:
        """Phrase test with boundaries, case folded, by padded token text."""
        return f"contains({self.padded(text)}, {self.padded(term)})"

    def flags(self, *checks) -> str:
        """Names of the checks (name, test) that hold, in their order."""
        return self.filter(self.array(*(f"CASE WHEN {test} THEN '{name}' END" for name, test in checks)), "x IS NOT NULL")


class Duck(Spark):
    name = "duck"
    sha = staticmethod(lambda x: f"sha256({x})")
    size = staticmethod(lambda a: f"len({a})")
    distinct = staticmethod(lambda a: f"list_distinct({a})")
    has_item = staticmethod(lambda a, x: f"list_contains({a}, {x})")
    join = staticmethod(lambda a, sep: f"array_to_string({a}, '{sep}')")
    sort = staticmethod(lambda a: f"list_sort({a})")
    minus = staticmethod(lambda a, b: f"list_filter(list_distinct({a}), lambda x: NOT list_contains({b}, x))")
    explode = staticmethod(lambda a: f"unnest({a})")
    most = staticmethod(lambda a: f"list_max({a})")
    posexplode = staticmethod(lambda a: f"unnest(range(0, len({a}))) AS pos, unnest({a}) AS x")
    starts = staticmethod(lambda a, b: f"starts_with({a}, {b})")
    ends = staticmethod(lambda a, b: f"ends_with({a}, {b})")
    array = staticmethod(lambda *x: f"[{', '.join(x)}]")
    last_known = staticmethod(lambda x, over: f"last_value({x} IGNORE NULLS) OVER ({over})")
    joined = staticmethod(lambda x, sep=",": f"coalesce(string_agg({x}, '{sep}' ORDER BY {x}), '')")
    joined_set = staticmethod(lambda x, sep=",": f"coalesce(string_agg(DISTINCT {x}, '{sep}' ORDER BY {x}), '')")
    joined_by = staticmethod(lambda x, by, sep: f"coalesce(string_agg({x}, '{sep}' ORDER BY {by}, {x}), '')")
    item = staticmethod(lambda a, i: f"({a})[{i}]")
    json = staticmethod(lambda c, key: f"json_extract_string({c}, '$.{key}')")
    count_if = staticmethod(lambda test: f"count_if({test})")
    key = staticmethod(lambda x: f"sha256({x})")

    @staticmethod
    def rx(p: str) -> str:
        return "'" + p + "'"

    def n(self, col: str, p: str) -> str:
        return f"len(regexp_extract_all({col}, {self.rx(p)}))"

    def n_any(self, col: str, words) -> str:
        return self.n(col, "|".join(words))

    def n_of(self, col: str, p: str, marks) -> str:
        return self.n(col, p)

    def padded(self, text: str) -> str:
        return f"(' ' || {self.join(self.all(f"lower(coalesce({text}, ''))", r"[\p{L}\p{N}_]+"), ' ')} || ' ')"

    def has(self, col: str, p: str) -> str:
        return f"regexp_matches({col}, {self.rx(p)})"

    def ext(self, col: str, p: str, group: int = 1) -> str:
        return f"regexp_extract({col}, {self.rx(p)}, {group})"

    def all(self, col: str, p: str) -> str:
        return f"regexp_extract_all({col}, {self.rx(p)})"

    def sub(self, col: str, p: str, put: str = "") -> str:
        return f"regexp_replace({col}, {self.rx(p)}, '{re.sub('[$]([0-9])', chr(92) * 2 + chr(92) + '1', put)}', 'g')"

    def filter(self, a: str, cond: str) -> str:
        return f"list_filter({a}, lambda x: {cond})"

    def map(self, a: str, expr: str) -> str:
        return f"list_transform({a}, lambda x: {expr})"

    def ext_of(self, col: str, pattern: str, group: int) -> str:
        return f"coalesce(nullif(regexp_extract_all({col}, {pattern}, {group}), [])[1], '')"

    def by_length(self, a: str) -> str:
        return f"list_transform(list_sort(list_transform({a}, lambda x: {{'n': -length(x), 'x': x}})), lambda y: y.x)"

    def heads(self, a: str) -> str:
        return f"list_distinct(flatten(list_transform({a}, lambda x: list_transform(range(1, least(4, length(x)) + 1), lambda i: substring(x, 1, i)))))"

    def differ(self, a: str, b: str, test) -> str:
        return f"len(list_filter(list_zip({a}, {b}), lambda z: {test('z[1]', 'z[2]')})) > 0"

    def split(self, col: str, sep: str) -> str:
        return f"string_split({col}, '{sep}')"

    def settled(self, query: str) -> str:
        return query


SPARK, DUCK = Spark(), Duck()
