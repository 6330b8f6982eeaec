"""Rules on LaTeX fragments as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import any_of, strip

# Commands and names that results depend on.
COMPLEX = (r"\frac", r"\int", r"\sum", r"\prod", r"\sqrt", r"\begin", r"\lim", r"\infty", r"\partial", r"\nabla", r"\matrix", r"\bmatrix", r"\pmatrix", r"\underbrace", r"\overbrace", r"\overset", r"\underset")
GREEK = ("alpha", "beta", "gamma", "delta", "epsilon", "varepsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu", "nu", "xi", "pi", "rho", "sigma", "tau", "upsilon", "phi", "chi", "psi", "omega", "Gamma", "Delta", "Theta", "Lambda", "Xi", "Pi", "Sigma", "Phi", "Psi", "Omega")
PAGE_NOISE = r"Problem \d+ continued on next page[.\u2026]*\s*|Problem \d+ \(continued\)\s*|\\extramarks\w*\s*|\\enterProblemHeader\{[^}]*\}\s*|\\exitProblemHeader\{[^}]*\}\s*"
ARGUMENT_NOISE = r"^(?:automata|positioning|plain|auto|grid)[,\s]*(?:automata|positioning|plain|auto|grid|[,\s])*$"
LISTING_NOISE = r"^(?:frame|rulecolor|numbers|numbersep|numberstyle|commentstyle|basicstyle|keywordstyle|showstringspaces|xleftmargin|framexleftmargin|breaklines|postbreak|stringstyle|identifierstyle|tabsize|backgroundcolor|captionpos|escapeinside|language|style)\s*="

SYMBOLS = (
    ("\\gets", "←"), ("\\leftarrow", "←"), ("\\rightarrow", "→"), ("\\geq", "≥"), ("\\leq", "≤"), ("\\neq", "≠"), ("\\ne", "≠"), ("\\times", "×"), ("\\cdot", "·"), ("\\ldots", "…"), ("\\infty", "∞"), ("\\in", "∈"),
    ("\\notin", "∉"), ("\\subseteq", "⊆"), ("\\cup", "∪"), ("\\cap", "∩"), ("\\forall", "∀"), ("\\exists", "∃"), ("\\neg", "¬"), ("\\land", "∧"), ("\\lor", "∨"), ("\\to", "→"), ("\\Rightarrow", "⇒"), ("\\Leftarrow", "⇐"),
    ("\\Leftrightarrow", "⇔"), ("\\alpha", "α"), ("\\beta", "β"), ("\\gamma", "γ"), ("\\delta", "δ"), ("\\epsilon", "ε"), ("\\theta", "θ"), ("\\lambda", "λ"), ("\\mu", "μ"), ("\\pi", "π"), ("\\sigma", "σ"), ("\\tau", "τ"),
    ("\\phi", "φ"), ("\\psi", "ψ"), ("\\omega", "ω"),
)
OPENS = ("\\Function", "\\Procedure", "\\If", "\\For", "\\While")
TURNS = ("\\ElsIf", "\\Else")
CLOSES = ("\\EndFunction", "\\EndProcedure", "\\EndIf", "\\EndFor", "\\EndWhile")


def symbols(c: Column) -> Column:
    """Known commands as their characters, one after another in this order; other commands lose the backslash."""

    def told(x: Column) -> Column:
        y = x
        for command, character in SYMBOLS:
            y = F.replace(y, F.lit(command), F.lit(character))
        return F.when(F.contains(x, F.lit("\\")), F.regexp_replace(y, r"\\([A-Za-z]+)", "$1")).otherwise(x)

    return bound(c, told)


def bound(value: Column, use) -> Column:
    """What use makes of the value, which is computed once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def bare(c: Column) -> Column:
    return F.regexp_replace(c, r"^[{}]+|[{}]+$", "")


def math_class(source: Column, display: Column) -> Column:
    s = strip(source)
    clean = bare(s)
    hard = any_of(s.contains(x) for x in COMPLEX) | ((F.length(clean) > 10) & clean.rlike(r"[+\-*/=<>]")) | ((display == "block") & (F.length(clean) > 5))
    return F.when(s == "", "trivial").when(hard, "complex").otherwise("trivial")


def math_words(source: Column) -> Column:
    """Words for a trivial formula; what no rule knows stays as it is."""
    s = bare(strip(source))
    part = lambda p, k: F.regexp_extract(s, p, k)
    sub, power, letter = r"^([a-zA-Z])_\{?([a-zA-Z0-9]+)\}?$", r"^([a-zA-Z])\^\{?(\d+)\}?$", r"^([a-zA-Z])\^\{?([a-zA-Z])\}?$"
    greek = s.isin(*("\\" + g for g in GREEK))
    return (
        F.when(s.rlike(r"^-?\d+\.?\d*$"), s)
        .when(greek, F.substring(s, 2, 100))
        .when(s.rlike(r"^[a-zA-Z]!$"), F.concat(F.substring(s, 1, 1), F.lit(" factorial")))
        .when(s.rlike(sub), F.concat(part(sub, 1), F.lit(" sub "), part(sub, 2)))
        .when(s.rlike(power) & (part(power, 2) == "2"), F.concat(part(power, 1), F.lit(" squared")))
        .when(s.rlike(power) & (part(power, 2) == "3"), F.concat(part(power, 1), F.lit(" cubed")))
        .when(s.rlike(power), F.concat(part(power, 1), F.lit(" to the "), part(power, 2)))
        .when(s.rlike(letter), F.concat(part(letter, 1), F.lit(" to the "), part(letter, 2)))
        .otherwise(s)
    )


def is_pseudocode(c: Column) -> Column:
    has = lambda words: c.rlike(rf"\\({words})\b")
    step = has("State|Return")
    return (has("Function|Procedure|If|While|For") & has("State|EndIf|EndFunction|EndProcedure|EndFor|EndWhile")) | (step & has("Call")) | (has("Require|Ensure") & step)


_ATOM = r"\\[\p{L}*]*|\{|\}|\n|[^\\{}\n]+"
_NO_STRINGS = "array<string>"


def command_tokens(c: Column) -> Column:
    """Commands, groups in matching braces (with the braces) and the texts between them: a fold over the text's atoms that keeps the depth of braces."""

    def step(state: Column, atom: Column) -> Column:
        command, begins, ends = atom.startswith("\\"), atom == "{", atom == "}"
        depth, text = state["depth"], state["text"]
        done = lambda value: F.concat(state["tokens"], F.when(strip(text) != "", F.array(strip(text))).otherwise(F.array().cast(_NO_STRINGS)), value)
        none = F.array().cast(_NO_STRINGS)
        as_state = lambda tokens, text, depth: F.struct(tokens.alias("tokens"), text.alias("text"), depth.cast("int").alias("depth"))
        within = F.when(ends & (depth == 1), as_state(F.concat(state["tokens"], F.array(F.concat(text, atom))), F.lit(""), F.lit(0))).otherwise(as_state(state["tokens"], F.concat(text, atom), F.when(begins, depth + 1).when(ends, depth - 1).otherwise(depth)))
        outside = F.when(command, as_state(done(F.array(atom)), F.lit(""), F.lit(0))).when(begins, as_state(done(none), atom, F.lit(1))).when(atom == "\n", as_state(done(none), F.lit(""), F.lit(0))).otherwise(as_state(state["tokens"], F.concat(text, atom), F.lit(0)))
        return F.when(depth > 0, within).otherwise(outside)

    start = F.struct(F.array().cast(_NO_STRINGS).alias("tokens"), F.lit("").alias("text"), F.lit(0).alias("depth"))
    return F.aggregate(F.regexp_extract_all(c, F.lit(_ATOM), F.lit(0)), start, step, lambda state: F.filter(F.concat(state["tokens"], F.array(F.when(state["depth"] > 0, state["text"]).otherwise(strip(state["text"])))), lambda x: x != ""))


def _unbraced(token: Column) -> Column:
    return F.when(token.startswith("{") & token.endswith("}"), strip(F.substring(token, F.lit(2), F.length(token) - 2))).otherwise(token)


def _escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def pseudocode(c: Column) -> Column:
    """Commands of the algorithmic packages as indented lines; null if there is no line. A command takes the groups and texts up to the next one, and a fold over the commands keeps the indent."""
    none = F.array().cast(_NO_STRINGS)
    strong = lambda word: F.lit(f"<strong>{word}</strong>")

    def said(command: Column, args: Column, lead: Column) -> Column:
        """The line of one command without its indent, null for none."""
        at = lambda k: F.coalesce(F.get(args, F.lit(k)), F.lit(""))
        group = lambda k: F.when(at(k).startswith("{"), _unbraced(at(k))).otherwise("")
        condition = _escaped(symbols(F.array_join(F.transform(lead, _unbraced), " ")))
        statement = _escaped(strip(symbols(F.array_join(F.transform(args, _unbraced), " "))))
        after = lambda word, mark="": bound(statement, lambda x: F.when(x != "", F.concat(strong(word + mark), F.lit(" "), x)).otherwise(strong(word + mark)))
        head = lambda word: F.concat(strong(word), F.lit(" "), _escaped(group(0)), F.lit("("), _escaped(group(1)), F.lit("):"))
        asked = lambda word: F.concat(strong(word), F.lit(" "), condition, F.lit(":"))
        return (
            F.when(command == "\\Function", head("Function"))
            .when(command == "\\Procedure", head("Procedure"))
            .when(command == "\\If", asked("If"))
            .when(command == "\\ElsIf", asked("Else If"))
            .when(command == "\\For", asked("For"))
            .when(command == "\\While", asked("While"))
            .when(command == "\\Else", F.concat(strong("Else"), F.lit(":")))
            .when(command == "\\State", bound(statement, lambda x: F.when(x != "", x)))
            .when(command == "\\Return", after("Return"))
            .when(command == "\\Require", after("Require", ":"))
            .when(command == "\\Ensure", after("Ensure", ":"))
            .when(command == "\\Call", F.concat(_escaped(_unbraced(at(0))), F.lit("("), _escaped(symbols(_unbraced(at(1)))), F.lit(")")))
        )

    def gather(state: Column, token: Column) -> Column:
        """Commands with what follows them: all of it, and the groups before the first text."""
        is_command = token.startswith("\\")
        now = state["now"]
        fresh = F.struct(token.alias("command"), none.alias("args"), none.alias("lead"))
        more = F.struct(now["command"].alias("command"), F.concat(now["args"], F.array(token)).alias("args"), F.when(token.startswith("{") & (F.size(now["args"]) == F.size(now["lead"])), F.concat(now["lead"], F.array(token))).otherwise(now["lead"]).alias("lead"))
        return F.struct(F.when(is_command, F.concat(state["done"], F.array(now))).otherwise(state["done"]).alias("done"), F.when(is_command, fresh).otherwise(more).alias("now"))

    nothing = F.struct(F.lit("").alias("command"), none.alias("args"), none.alias("lead"))
    commands = F.aggregate(command_tokens(c), F.struct(F.array().cast("array<struct<command:string,args:array<string>,lead:array<string>>>").alias("done"), nothing.alias("now")), gather, lambda state: F.concat(state["done"], F.array(state["now"])))
    lines = F.transform(commands, lambda x: F.struct(x["command"].alias("command"), said(x["command"], x["args"], x["lead"]).alias("line")))

    def indent(state: Column, x: Column) -> Column:
        back = x["command"].isin(*TURNS, *CLOSES)
        level = F.when(back, F.greatest(state["level"] - 1, F.lit(0))).otherwise(state["level"])
        line = F.when(x["line"].isNotNull(), F.array(F.concat(F.repeat(F.lit("    "), level), x["line"]))).otherwise(none)
        return F.struct((level + x["command"].isin(*OPENS, *TURNS).cast("int")).alias("level"), F.concat(state["lines"], line).alias("lines"))

    out = F.aggregate(lines, F.struct(F.lit(0).alias("level"), none.alias("lines")), indent, lambda state: state["lines"])
    return bound(out, lambda x: F.when(F.size(x) > 0, F.concat(F.lit('<pre class="algorithm">\n'), F.array_join(x, "\n"), F.lit("\n</pre>"))))


def is_tikz(c: Column) -> Column:
    return c.rlike(r"\\(node|draw|path|tikz)\b|tikzpicture")


def tikz_placeholder(c: Column) -> Column:
    nodes, edges = F.regexp_count(c, F.lit(r"\\node\b")), F.regexp_count(c, F.lit(r"\\draw\b|\\path\b.*?edge\b|--\s*\("))
    counted = lambda n, word: F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n != 1, "s").otherwise(""))
    automaton = c.rlike(r"\\node\s*\[.*?state") & (nodes > 0)
    kind = F.when(automaton, "finite automaton").when((nodes > 0) | (edges > 0), "diagram").otherwise("drawing")
    some = lambda n, word: F.when(n > 0, counted(n, word))
    detail = F.when(automaton, F.concat_ws(" and ", counted(nodes, "state"), some(edges, "transition"))).otherwise(F.concat_ws(" and ", some(nodes, "node"), some(edges, "edge")))
    middle = F.when(kind == "drawing", F.lit("It contains TikZ drawing commands.")).otherwise(F.concat(F.lit("It contains a TikZ "), kind, F.lit(" with "), detail, F.lit(".")))
    return F.concat_ws(" ", F.concat(F.lit("[Diagram: This "), kind, F.lit(" could not be automatically converted.")), middle, F.lit("Please refer to the original document or provide a description.]"))


def without_noise(c: Column) -> Column:
    s = F.regexp_replace(c, PAGE_NOISE, "")
    lines = F.filter(F.split(s, "\n"), lambda x: (strip(x) != "") & ~strip(x).rlike(ARGUMENT_NOISE))
    return F.when(strip(s).rlike(LISTING_NOISE), "").otherwise(F.regexp_replace(strip(F.array_join(lines, "\n")), "  +", " "))


def error_marks(html: Column) -> tuple[Column, Column]:
    """Numbers of conversion errors and of formulas left unread."""
    return F.regexp_count(html, F.lit('class="ltx_ERROR')), F.regexp_count(html, F.lit('class="ltx_math_unparsed"'))


def warnings(stderr: Column) -> Column:
    lines = F.transform(F.split(stderr, "\n"), strip)
    told = lambda x: any_of(x.contains(w) for w in ("Warning:", "Error:", "missing_file", "undefined"))
    return F.filter(lines, lambda x: told(x) & ~(x.startswith("(") & x.contains("sec)")))
