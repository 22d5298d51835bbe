"""JavaScript and TypeScript sources as masked text with nesting, by a pushdown automaton.

A source is split into small tokens once, whatever they stand in. One fold then walks
them with a stack of what is open: strings, templates and the code in their ``${}``,
comments, regular expressions and brackets, to any depth. Whether a ``/`` divides or opens
a regular expression is told by what came before; after ``)`` by the word before its ``(``,
after ``}`` by what opened it.

The result is the source without what is not code, line by line as it was: comments are
gone, strings and templates hold only text that says something to a rule (names, numbers,
``*``), regular expressions are strings. Every bracket is followed by a mark of its depth,
the same for both of a pair, so that a pattern can take or skip a bracketed part whole.

A source is ``whole`` if everything it opens is closed by its own kind, no string or
regular expression goes over a line, and no bracket is too many.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlake.functions.text import bind

#: Marks of depth are characters for private use; beyond DEPTHS they repeat.
FIRST_MARK, DEPTHS = 0xE000, 1_000
MARK = f"[\\x{{{FIRST_MARK:x}}}-\\x{{{FIRST_MARK + DEPTHS - 1:x}}}]"
#: Stands for text in a string, template or regular expression that says nothing to a rule.
HIDDEN = "\x05"
#: Tokens that are folded before their text is put to the rest; keeps a large source's cost in proportion to its size.
RUN = 512

_SMALL = r"(?s)\\(?!\*/).|//|/\*|\*/|\$\{|[^\\\n\"'`/(){}\[\]*$]++|."
# Without templates, strings and comments are tokens as wholes, lines of comments one after the other one token ...
_LARGE = (
    r"(?s)\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|//[^\n]++(?:\n *+//[^\n]*+)*+|/\*.*?\*/"
    r"|\\(?!\*/).|//|/\*|\*/|[^\\\n\"'/(){}\[\]*]++|."
)
# ... if no regular expression may hold a quote, nor a comment's beginning.
_RISKY = r"`|/(?![/*])[^\n/]*[\"'\\\[]"
_MARKS = "".join(map(chr, range(FIRST_MARK, FIRST_MARK + DEPTHS)))
_SPECIAL = "\"'`///*([{${)]}"

_BEFORE_WORD = r"(?:^|[^\w$.])"
# The language's words after which a bracket or a value begins.
_HEADS = rf"{_BEFORE_WORD}(?:if|while|for|with)\s*\z"
_OPERATOR_WORDS = rf"{_BEFORE_WORD}(?:return|typeof|case|in|of|delete|void|throw|new|instanceof|yield|await|default|extends)\s*\z"
_STATEMENT = rf"(?:=>|;)\s*\z|{_BEFORE_WORD}(?:do|else|try|finally)\s*\z"
_VALUE = r"(?:[\w$\x{80}-\x{10ffff}]|\+\+|--)\s*\z"
# What came last is the text of the code before, or one of these.
_ENDED, _BEGUN = "\x01", "\x02"  # a value, a statement or the source


def _mark(depth: Column) -> Column:
    return F.substring(F.lit(_MARKS), F.pmod(depth, F.lit(DEPTHS)).cast("int") + 1, F.lit(1))


def _divides(last: Column) -> Column:
    """Whether a value has ended."""
    return (last == _ENDED) | (last.rlike(_VALUE) & ~last.rlike(_OPERATOR_WORDS) & ~last.rlike(_HEADS) & ~last.rlike(_STATEMENT))


def _wants_value(last: Column) -> Column:
    return ~last.isin(_ENDED, _BEGUN) & ~last.rlike(_STATEMENT) & (last.rlike(_OPERATOR_WORDS) | ~last.rlike(_VALUE))


def _action(code: Column, top: Column, last: Column, token: Column) -> Column:
    """``+x`` opens x, ``-`` closes the top, nothing does neither; ``!`` tells of a broken source."""
    breaks = token.endswith("\n")
    in_string = F.when(token == top, "-").when(token == "\n", "!-").otherwise("")
    in_template = F.when(token == "`", "-").when(token == "${", "+$").otherwise("")
    in_regex = F.when(token.isin("/", "//", "/*", "*/"), "-").when(token == "[", "+k").when(breaks, "!-").otherwise("")
    in_class = F.when(token == "]", "-").when(breaks, "!-").otherwise("")
    in_code = (
        F.when((F.length(token) > 2) | ~F.contains(F.lit(_SPECIAL), token), "")
        .when(token == "(", F.when(last.rlike(_HEADS), "+P").otherwise("+("))
        .when(token == ")", F.when(top.isin("(", "P"), "-").otherwise("!"))
        .when(token.isin('"', "'", "`"), F.concat(F.lit("+"), token))
        .when(token.isin("{", "${"), F.when(_wants_value(last), "+O").otherwise("+{"))
        .when(token == "}", F.when(top.isin("{", "O", "$"), "-").otherwise("!"))
        .when(token == "[", "+[")
        .when(token == "]", F.when(top == "[", "-").otherwise("!"))
        .when(token == "//", "+/")
        .when(token == "/*", "+*")
        .when(token == "/", F.when(_divides(last), "").otherwise("+r"))
        .otherwise("")
    )
    return F.when(code, in_code).otherwise(
        F.when(top.isin('"', "'"), in_string)
        .when(top == "`", in_template)
        .when(top == "/", F.when(breaks, "-").otherwise(""))
        .when(top == "*", F.when(token == "*/", "-").otherwise(""))
        .when(top == "r", in_regex)
        .otherwise(in_class)
    )


_TEXTS = ('"', "'", "`", "/", "*", "r", "k")


def _last(top: Column, last: Column, action: Column) -> Column:
    """What came last when something was opened or closed."""
    closed = F.when(top.isin('"', "'", "`", "r", "(", "[", "O"), _ENDED).when(top.isin("P", "{"), _BEGUN).otherwise(last)
    opened = F.when(action.isin("+/", "+*"), last).when(action.isin("+{", "+O"), _BEGUN).otherwise("(")
    return F.when(action.startswith("+"), opened).otherwise(closed)


def _shown(top: Column, stack: Column, token: Column, action: Column) -> Column:
    """What is left of a token that opens or closes."""
    breaks = F.when(token.endswith("\n"), "\n").otherwise("")
    opening = (
        F.when(action.isin("+(", "+P", "+{", "+O", "+[", "+$"), F.concat(token, _mark(F.length(stack) + 1)))
        .when(action == "+`", "`")
        .when(action == "+*", " ")
        .when(action == "+r", '"' + HIDDEN)
        .when(action.isin("+/", "+k"), "")
        .otherwise('"')
    )
    closing = (
        F.when(top.isin("(", "P", "{", "O", "[", "$"), F.concat(token, _mark(F.length(stack))))
        .when(top == "`", "`")
        .when(top.isin("/", "*", "k"), breaks)
        .otherwise(F.concat(F.lit('"'), breaks))
    )
    return F.when(action.startswith("+"), opening).when(action.endswith("-"), closing).otherwise(token)


_BREAKS_ONLY = r"[^\n]+"


def _inside(top: Column, token: Column) -> Column:
    """What is left of a token in a string, template, comment or regular expression."""
    breaks = F.when(token.endswith("\n"), "\n").otherwise("")
    hidden = F.when(token == "\n", token).otherwise(F.concat(F.lit(HIDDEN), breaks))
    kept = F.when(token.rlike(r"^(?:[\w$]+|\*)\z"), token).otherwise(hidden)
    return F.when(top.isin('"', "'"), kept).when(top == "`", hidden).otherwise(breaks)


def _in_code(token: Column) -> Column:
    """What is left of a token in code that neither opens nor closes: whole strings and comments are such."""
    first = F.substring(token, 1, 1)
    breaks = F.regexp_replace(token, _BREAKS_ONLY, "")
    string = F.when(token.rlike(r"^.(?:[\w$]+|\*)?.\z"), F.concat(F.lit('"'), F.substring(token, F.lit(2), F.length(token) - 2), F.lit('"')))
    return (
        F.when(F.length(token) < 2, token)
        .when(first.isin('"', "'"), string.otherwise(F.concat(F.lit('"' + HIDDEN + '"'), breaks)))
        .when(token.startswith("//"), F.replace(F.regexp_replace(token, "//[^\\n]++", " "), F.lit("//"), F.lit("")))
        .when(token.startswith("/*"), F.concat(F.lit(" "), breaks))
        .otherwise(token)
    )


def _after(last: Column, token: Column) -> Column:
    """What came last after such a token."""
    first = F.substring(token, 1, 1)
    return (
        F.when((token == "\n") | (F.ltrim(token) == "") | token.startswith("//") | token.startswith("/*"), last)
        .when(first.isin('"', "'"), _ENDED)
        .otherwise(token)
    )


def code_text(content: Column) -> Column:
    """A struct of ``text``, the masked source, and ``whole``."""

    def step(state: Column, token: Column) -> Column:
        stack, top, code, last = state["stack"], state["top"], state["code"], state["last"]

        def made(stack: Column, top: Column, code: Column, last: Column, whole: Column, shown: Column) -> Column:
            text = F.concat(state["text"], shown)
            return F.struct(stack.alias("stack"), top.alias("top"), code.alias("code"), last.alias("last"), whole.alias("whole"), text.alias("text"))

        def moved(action: Column) -> Column:
            grown = (
                F.when(action.startswith("+"), F.concat(stack, F.substring(action, 2, 1)))
                .when(action.endswith("-"), F.substring(stack, F.lit(1), F.length(stack) - 1))
                .otherwise(stack)
            )
            shown, ended, whole = _shown(top, stack, token, action), _last(top, last, action), state["whole"] & ~action.startswith("!")
            changed = bind(
                grown, lambda now: bind(F.right(now, F.lit(1)), lambda up: made(now, up, ~up.isin(*_TEXTS), ended, whole, shown))
            )
            same = made(
                stack, top, code, F.when(code, _after(last, token)).otherwise(last), state["whole"],
                F.when(code, _in_code(token)).otherwise(_inside(top, token)),
            )
            return F.when(action == "", same).otherwise(changed)

        return bind(_action(code, top, last, token), moved)

    def fold(tokens: Column) -> Column:
        names = ("stack", "top", "code", "last", "whole")
        start = F.struct(
            F.lit("").alias("stack"), F.lit("").alias("top"), F.lit(True).alias("code"), F.lit(_BEGUN).alias("last"),
            F.lit(True).alias("whole"), F.array().cast("array<string>").alias("texts"),
        )

        def run(state: Column, at: Column) -> Column:
            fresh = F.struct(*(state[n].alias(n) for n in names), F.lit("").alias("text"))
            done = F.aggregate(F.slice(tokens, at, F.lit(RUN)), fresh, step)
            return bind(
                done, lambda d: F.struct(*(d[n].alias(n) for n in names), F.concat(state["texts"], F.array(d["text"])).alias("texts"))
            )

        return F.aggregate(
            F.sequence(F.lit(1), F.greatest(F.size(tokens), F.lit(1)), F.lit(RUN)),
            start,
            run,
            lambda s: F.struct(F.array_join(s["texts"], "").alias("text"), (s["whole"] & s["stack"].isin("", "/")).alias("whole")),
        )

    lines = F.replace(content, F.lit("\r\n"), F.lit("\n"))
    small = F.regexp_extract_all(lines, F.lit(_SMALL), F.lit(0))
    large = F.regexp_extract_all(lines, F.lit(_LARGE), F.lit(0))
    return bind(F.when(lines.rlike(_RISKY), small).otherwise(large), fold)


def without_marks(text: Column) -> Column:
    return F.regexp_replace(text, MARK, "")


#: A bracketed part as a whole; ``{n}`` is the number of the group that holds its mark.
def bracketed(number: int) -> str:
    return rf"(?>[(\[{{]({MARK})(?s:.*?)[)\]}}]\{number})"
