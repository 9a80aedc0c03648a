"""Text functions over agent steps as Column builders: all of them stay inside Catalyst.

Regular expressions follow Python's rules: `(?d)` keeps newline as the only line end, `(?U)` makes \\w, \\d, \\s and \\b
know Unicode. Null in gives null out unless a function says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that results depend on.
GITHUB_URL = r"(?i)^(?:https?://)?(?:www\.)?github\.com/([^/\s]+)/([^/\s]+?)(?:\.git)?/?$"
OWNER_REPO = r"^([A-Za-z0-9_.-]+)/([A-Za-z0-9_.-]+)$"
INSTANCE_ID = r"^([A-Za-z0-9_.-]+?)__([A-Za-z0-9_-]+?)(?:-\d+|\.[0-9a-f]{6,}.*|__.*)?$"
NUMBER = r"(?U)\b\d+\b"
PATH = r"(?U)(?:/[\w.\-]+)+|[\w.\-]+\.(?:py|js|ts|rs|go|java|c|cpp|h|md|txt|toml|cfg|ini|yaml|yml|json)\b"
EDIT_RANGE = r"^edit (\d+):(\d+)"
N_PASSED = r"(?U)\b(\d+) passed\b"
N_FAILED = r"(?U)\b(\d+) (?:failed|errors?)\b"
UNIT_RAN = r"(?md)^Ran (\d+) tests? in"
UNIT_FAILED = r"(?md)^FAILED \((?:failures=(\d+))?(?:, )?(?:errors=(\d+))?"
UNIT_OK = r"(?md)^OK\b"
EXCEPTION_LINE = r"(?U)^\s*(?:[\w.]+\.)?\w*(?:Error|Exception|Warning)\b"
LISTING_LINE = r"(?U)^\s*(?:\d+[:\t|]|Line \d+:|#|\.\.\.)"
STRICT_ERROR = r"(?U)\b(?:\w*Error|\w*Exception)\b\s*:|^\s*Traceback \(most recent|No such file or directory|not found\b|FAILED\b|fatal:"
EDIT_OK = r"(?i)File updated|has been edited|Your changes have been saved|successfully|The file .* has been created"
EDIT_BAD = r"(?i)Your proposed edit has introduced|did not appear verbatim|No replacement was performed|Invalid `path`|is not a valid|does not exist"
EXPLORE = r"^(?:open|cat|less|head|tail|view|ls|find|find_file|search_dir|search_file|grep|rg|str_replace_editor view|tree)\b"
NAVIGATION = r"^(?:scroll_down|scroll_up|goto|open|ls|cd|pwd|cat|less|head|tail|find|find_file|search_dir|search_file|grep|rg|tree|str_replace_editor view|git (?:status|diff|log))\b"
EDIT = r"^(?:edit\b|str_replace_editor (?:str_replace|create|insert)\b|sed -i\b|cat >\s*|echo .* >\s*)"
FINISH = ("submit", "finish")
FOOTER = r"(?md)^\((?:Open file|Current directory): [^)]*\)\s*$|^bash-\$\s*$"
ANSI = r"\x1b\[[0-9;]*[A-Za-z]"
RULE = r"(?md)^[=\-_*#]{6,}\s*$"
VERDICT = r"(?mdi)^.*\b(?:instance|task)\s+(?:resolved|unresolved)\b.*$|^\s*(?:RESOLVED|UNRESOLVED|FAIL_TO_PASS|PASS_TO_PASS)\b.*$"
TEST_SUMMARY = r"(?iU)\b(\d+ (?:passed|failed|error|errors|skipped|xfailed|warnings?))\b"
ERROR_LINE = r"(?mdU)^.*\b(?:Error|Exception|Traceback|FAILED|fatal:|not found|No such file|SyntaxError)\b.*$"
PADDING = r"([=\-_*#~.])\1{7,}"
INNER_SPACES = r"(?<=\S) {3,}(?=\S)"
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

Text = Column | str


def _c(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body(x) with x computed once, however often the body names it: expressions of this module nest, and would
    otherwise be copied into each other."""
    return F.element_at(F.transform(F.array(x), body), 1)


def strip(x: Text) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+\z", "")


def lines_of(x: Text) -> Column:
    """Lines by all of Unicode's line ends, without an empty one after the last."""
    return let(F.split(_c(x), LINE_ENDS, -1), lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts))


def repo_key(x: Text) -> Column:
    """`owner/repo` in lower case from a repository URL, `owner/repo`, or an instance id; null if it is none of them."""
    s = strip(x)

    def by(pattern: str) -> Column:
        return F.when(s.rlike(pattern), F.concat(F.regexp_extract(s, pattern, 1), F.lit("/"), F.regexp_extract(s, pattern, 2)))

    return F.lower(F.coalesce(by(GITHUB_URL), by(OWNER_REPO), by(INSTANCE_ID)))


def normalize_action(x: Text) -> Column:
    return F.regexp_replace(strip(x), r"(?U)\s+", " ")


def one_line(x: Text, most: int = 80) -> Column:
    return let(normalize_action(x), lambda a: _ellipsis(a, most))


def _ellipsis(a: Column, most: int) -> Column:
    return F.when(F.length(a) <= most, a).otherwise(F.concat(F.substring(a, 1, most - 3), F.lit("...")))


def action_family(x: Text) -> Column:
    """Command word (two for the editor tool), distinct paths in order, numbers as #, and the tens of an edited range."""
    return let(normalize_action(x), _family)


def _family(a: Column) -> Column:
    head = F.when(F.substring_index(a, " ", 1) == "str_replace_editor", F.substring_index(a, " ", 2)).otherwise(F.substring_index(a, " ", 1))
    paths = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(a, F.lit(PATH), F.lit(0)))), " ")
    base = F.regexp_replace(F.trim(F.concat(head, F.lit(" "), paths)), NUMBER, "#")
    start = F.regexp_extract(a, EDIT_RANGE, 1)
    return F.trim(F.concat(base, F.when(start != "", F.concat(F.lit(" L"), F.floor(start.cast("double") / 10).cast("long").cast("string"))).otherwise(F.lit(""))))


def _last(x: Column, pattern: str) -> Column:
    return F.try_element_at(F.regexp_extract_all(x, F.lit(pattern), F.lit(1)), F.lit(-1)).cast("int")


def parse_test_counts(x: Text) -> Column:
    """struct(passed, failed) of the last test summary in a text; both null if there is none."""
    x = _c(x)
    p, f, ran = _last(x, N_PASSED), _last(x, N_FAILED), _last(x, UNIT_RAN)
    bad = sum((F.coalesce(F.regexp_extract(x, UNIT_FAILED, g).try_cast("int"), F.lit(0)) for g in (1, 2)), F.lit(0))
    summary = p.isNotNull() | f.isNotNull()
    unit_bad, unit_ok = ran.isNotNull() & x.rlike(UNIT_FAILED), ran.isNotNull() & x.rlike(UNIT_OK)
    passed = F.when(summary, F.coalesce(p, F.lit(0))).when(unit_bad, F.greatest(F.lit(0), ran - bad)).when(unit_ok, ran)
    failed = F.when(summary, F.coalesce(f, F.lit(0))).when(unit_bad, bad).when(unit_ok, F.lit(0))
    return F.struct(passed.alias("passed"), failed.alias("failed"))


def error_signature(x: Text) -> Column:
    """The line that names the error of an observation, numbers as #, 160 characters at most; null if there is none.
    The last line that starts like an exception, else the first with a strict marker; listings do not count."""
    return let(F.filter(lines_of(x), lambda s: s.rlike(r"(?U)\S") & ~s.rlike(LISTING_LINE)), _signature)


def _signature(lines: Column) -> Column:
    line = F.coalesce(F.try_element_at(F.filter(lines, lambda s: s.rlike(EXCEPTION_LINE)), F.lit(-1)), F.try_element_at(F.filter(lines, lambda s: s.rlike(STRICT_ERROR)), F.lit(1)))
    return F.substring(F.regexp_replace(strip(line), NUMBER, "#"), 1, 160)


def preslice(x: Text, keep: int) -> Column:
    """Head and tail of a long text, with a note of the lines left out."""
    return let(_c(x), lambda v: _sliced(v, keep))


def _sliced(x: Column, keep: int) -> Column:
    gone = F.length(x) - 2 * keep
    middle = F.substring(x, F.lit(keep + 1), gone)
    note = F.concat(F.lit("\n... ["), (F.length(middle) - F.length(F.replace(middle, F.lit("\n"), F.lit("")))).cast("string"), F.lit(" lines omitted] ...\n"))
    return F.when(F.length(x) <= 2 * keep + 64, x).otherwise(F.concat(F.substring(x, 1, keep), note, F.right(x, F.lit(keep))))


def collapse_padding(x: Text) -> Column:
    """Runs of a rule character as eight of it, column padding as two spaces."""
    return F.regexp_replace(F.regexp_replace(_c(x), PADDING, "$1" * 8), INNER_SPACES, "  ")


def clean_observation(x: Text) -> Column:
    """Without padding, colour codes, verdicts, shell footers and rules; blank lines never repeat."""
    x = collapse_padding(x)
    for pattern in (ANSI, VERDICT, FOOTER, RULE):
        x = F.regexp_replace(x, pattern, "")
    x = F.array_join(F.transform(lines_of(x), lambda s: F.regexp_replace(s, r"(?U)\s+\z", "")), "\n")
    return strip(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def summarize_observation(x: Text, most: int = 100) -> Column:
    """Test summary, else first error line, else first line of an observation."""
    return let(clean_observation(preslice(collapse_padding(x), 4000)), lambda t: _summary(t, most))


def _summary(t: Column, most: int) -> Column:
    found = F.array_distinct(F.regexp_extract_all(t, F.lit(TEST_SUMMARY), F.lit(1)))
    line = strip(F.coalesce(F.nullif(F.regexp_extract(t, ERROR_LINE, 0), F.lit("")), F.try_element_at(lines_of(t), F.lit(1))))
    first = let(line, lambda s: _ellipsis(s, most))
    return F.when(t == "", F.lit("(no output)")).otherwise(let(found, lambda f: F.when(F.size(f) > 0, F.substring(F.array_join(f, ", "), 1, most)).otherwise(first)))


def token_count(x: Text) -> Column:
    """Tokens of a text by the 3.5 characters proxy."""
    return F.floor(F.length(_c(x)) / F.lit(3.5) + F.lit(0.999)).cast("int")


def cap(x: Text, most: Column | int) -> Column:
    """The longest start of a text that has at most `most` tokens with an ellipsis, by the proxy's inverse."""
    most = F.lit(most) if isinstance(most, int) else most
    return let(F.substring(_c(x), F.lit(1), most * 8), lambda cut: _capped(cut, most))


def _capped(cut: Column, most: Column) -> Column:
    room = F.floor(most * F.lit(3.5) + F.lit(0.0035)).cast("int") - 3
    short = F.concat(F.regexp_replace(F.substring(cut, F.lit(1), F.greatest(F.lit(0), room)), r"(?U)\s+\z", ""), F.lit("..."))
    return F.when(token_count(cut) <= most, cut).otherwise(short)


def truncate_middle(x: Text, most: int, head_share: float = 0.6) -> Column:
    """Head and tail lines of a long text within a token budget, with a note of the lines between."""
    return let(preslice(x, most * 6), lambda t: F.when(token_count(t) <= most, t).otherwise(let(lines_of(t), lambda lines: _middle_cut(t, lines, most, int(most * head_share)))))


def _fitting(part: Column, room: int) -> Column:
    """How many leading lines fit, newlines included."""
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), F.lit(True).alias("on"))

    def step(a: Column, s: Column) -> Column:
        cost = token_count(F.concat(s, F.lit("\n")))
        fits = a["on"] & (a["used"] + cost <= room)
        return F.struct(F.when(fits, a["used"] + cost).otherwise(a["used"]).alias("used"), F.when(fits, a["n"] + 1).otherwise(a["n"]).alias("n"), fits.alias("on"))

    return F.aggregate(part, start, step)["n"]


def _middle_cut(t: Column, lines: Column, most: int, head_room: int) -> Column:
    def with_head(h: Column) -> Column:
        rest = F.slice(lines, h + 1, F.size(lines))

        def with_tail(k: Column) -> Column:
            gone = F.size(lines) - h - k
            note = F.concat(F.lit("... ["), gone.cast("string"), F.lit(" lines omitted] ..."))
            return F.when(gone <= 0, t).otherwise(F.array_join(F.concat(F.slice(lines, F.lit(1), h), F.array(note), F.slice(lines, h + gone + 1, k)), "\n"))

        return let(_fitting(F.reverse(rest), most - head_room), with_tail)

    return let(_fitting(lines, head_room), with_head)


def join_parts(*parts: Text) -> Column:
    """Non-blank parts, stripped, with a blank line between; null if there are none."""
    kept = [F.nullif(strip(p), F.lit("")) for p in parts]
    return F.nullif(F.concat_ws("\n\n", *kept), F.lit(""))


def slug(x: Text) -> Column:
    """Runs of characters other than letters, digits, dot, underscore and hyphen as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(_c(x), r"[^A-Za-z0-9_.-]+", "_"), r"^_+|_+$", "")


def basename(x: Text) -> Column:
    return F.element_at(F.split(F.regexp_replace(_c(x), "/+$", ""), "/"), -1)


def prefix_fraction(length: Column, n: Column) -> Column:
    """length / n to four places, half to even."""
    return F.bround(length / n, 4)


def recent_block(state: Text) -> Column:
    """What stands between the first <recent> and the last </recent>."""
    s = _c(state)
    i, j = F.locate("<recent>", s), F.length(s) - F.locate(">tnecer/<", F.reverse(s)) - 8 + 1
    return F.when((i > 0) & (F.locate("</recent>", s) > 0) & (j > i), F.substring(s, i + 8, j - i - 8)).otherwise(F.lit(""))


def hist_block(state: Text) -> Column:
    s = _c(state)
    i, j = F.locate("<hist>", s), F.locate("</hist>", s)
    return F.when((i > 0) & (j > i), F.substring(s, i + 6, j - i - 6)).otherwise(F.lit(""))


def last_visible_action(state: Text) -> Column:
    """First word of the last `$ ` line from <recent> on; empty if there is none."""
    s = _c(state)
    tail = F.when(F.locate("<recent>", s) > 0, F.substring(s, F.locate("<recent>", s), F.length(s))).otherwise(s)
    return F.coalesce(F.try_element_at(F.regexp_extract_all(tail, F.lit(r"(?md)^\$ (\S+)"), F.lit(1)), F.lit(-1)), F.lit(""))


def tool_command(action: Text) -> Column:
    """The command of an action given as JSON with a command, else the action itself; empty for an object without one."""
    a = _c(action)
    return F.when(a.rlike(r"(?s)\A\s*\{.*\}\s*\z") & F.try_parse_json(a).isNotNull(), F.coalesce(F.get_json_object(a, "$.command"), F.lit(""))).otherwise(a)


def tool_observation(output: Text, code: Text, exception: Text | None = None) -> Column:
    """Output of a command, the exception under it if there is one, and its exit code where that is not 0."""
    text = F.coalesce(_c(output), F.lit(""))
    if exception is not None:
        text = F.when(F.coalesce(_c(exception), F.lit("")) != "", strip(F.concat(text, F.lit("\n"), _c(exception)))).otherwise(text)
    return F.when(_c(code) != 0, F.concat(text, F.lit("\n[exit "), _c(code).cast("string"), F.lit("]"))).otherwise(text)
