"""The boundary to language models: prompts, a model function, a stub and a rules model.

A model function maps pandas batches with the columns (prompt_hash, prompt) to (prompt_hash, response,
error). A remote provider is one more such function; none is part of this library.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import prefix
from lectern.operators.analysis import ANALYZERS, RECORDS
from lectern.sources.settings import Settings
from lectern.sources.shared import durable

ModelFn = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
ANSWERS = "prompt_hash string, response string, error string"

# How many characters of a text go into which prompt.
ITEMS_PREFIX, QUERY_PREFIX, SNIPPET_PREFIX, CHAT_PREFIX = 3000, 200, 200, 150_000

TASKS = {
    "spec_check": "Find brand names, makers and narrow specifications that keep bidders out, and see that equivalents are allowed.",
    "lcca": "Look for the costs of a whole life: buying, running, upkeep and disposal. Say which are missing.",
    "market_scope": "Hold the budget against market prices and say how many suppliers could deliver.",
    "green": "Look for environmental criteria: energy, materials, emissions, reuse. Say which are missing.",
    "tatak_pinoy": "See whether domestic goods, labour and suppliers get the preference that the law gives them.",
    "compliance": "Name the procurement mode that fits, why, and what it requires.",
}
TEMPLATES = {a: f"{TASKS[a]}\nAnswer with JSON of these fields only: {', '.join(RECORDS[a])}.\n\nDocument:\n{{document}}\n" for a in ANALYZERS}
TEMPLATES["market_scope"] += "\nMarket data:\n{market}\n"
TEMPLATES["items"] = "List the main items that this document procures, and their budget, one a line.\n\nDocument:\n{document}\n"
TEMPLATES["compile"] = (
    "Join these analyses into one verdict. FAIL on any finding of high severity, else PASS.\n"
    "Answer with JSON of these fields only: status, title (ten words at most), confidence (0 to 100), findings (category, items, severity).\n\nAnalyses:\n{analyses}\n"
)
TEMPLATES["chat"] = "Answer from the document and the report alone; say so if they don't tell.\n\nDocument:\n{document}\n\nReport:\n{report}\n\nQuestion: {query}\n"


def filled(template: str, **values: Column) -> Column:
    """A template with its {names} replaced; what is put in is never looked at for names again."""
    out, rest = [], template
    while rest:
        at = {rest.find("{" + name + "}"): name for name in values if "{" + name + "}" in rest}
        if not at:
            break
        first = min(at)
        out += [F.lit(rest[:first]), F.coalesce(values[at[first]], F.lit(""))]
        rest = rest[first + len(at[first]) + 2 :]
    return F.concat(*out, F.lit(rest))


def market_text(items: Column, results: Column | None = None, problem: Column | None = None) -> Column:
    """What the market analyzer is told: the items, then search results (title, content), or why there are none."""
    # Fixed values
    head = F.concat(F.lit("Market research for items:\n"), F.coalesce(items, F.lit("")), F.lit("\n\n"))
    out = F.lit("(Tavily API not configured - using document analysis only)")
    if results is not None:
        said = lambda x, name: F.coalesce(x[name], F.lit(""))
        lines = F.transform(results, lambda r: F.concat(F.lit("- "), said(r, "title"), F.lit(": "), prefix(said(r, "content"), SNIPPET_PREFIX), F.lit("\n")))
        out = F.when(results.isNotNull(), F.concat(F.lit("Search results:\n"), F.array_join(lines, ""))).otherwise(out)
    if problem is not None:
        out = F.when(problem.isNotNull(), F.concat(F.lit("(Market search unavailable: "), problem, F.lit(")"))).otherwise(out)
    return F.concat(head, out)


def market_query(items: Column) -> Column:
    """The search for market prices of some items."""
    return F.concat(F.lit("Philippines market price "), prefix(F.coalesce(items, F.lit("")), QUERY_PREFIX))


def analysis_prompts(documents: DataFrame, thread: str, text: str, market: str | None = None) -> DataFrame:
    """(thread, analyzer, prompt): one scan of the documents gives the six prompts, of whole texts."""
    about = F.col(market) if market else market_text(F.lit(""))
    each = [F.struct(F.lit(a).alias("analyzer"), filled(TEMPLATES[a], document=F.col(text), market=about).alias("prompt")) for a in ANALYZERS]
    return documents.select(thread, F.explode(F.array(*each)).alias("p")).select(thread, "p.*")


def items_prompts(documents: DataFrame, thread: str, text: str) -> DataFrame:
    """(thread, prompt): the first call of the market analyzer, over the beginning of the document."""
    return documents.select(thread, filled(TEMPLATES["items"], document=prefix(F.col(text), ITEMS_PREFIX)).alias("prompt"))


def chat_prompt(text: Column, report: Column, query: Column) -> Column:
    return filled(TEMPLATES["chat"], document=prefix(text, CHAT_PREFIX), report=report, query=query)


def compile_prompt(analyses: Column) -> Column:
    return filled(TEMPLATES["compile"], analyses=analyses)


def run_model(prompts: DataFrame, model: ModelFn, name: str = "answers") -> DataFrame:
    """``prompts`` with ``response`` and ``error``; a model is asked once for equal prompts.

    The answers are written before they are used, so that a lost task doesn't ask again for what is there.
    """
    keyed = prompts.withColumn("prompt_hash", F.sha2("prompt", 256))
    asked = keyed.select("prompt_hash", "prompt").dropDuplicates(["prompt_hash"])
    answers = durable(asked.mapInPandas(model, ANSWERS), f"model-{name}")
    return keyed.join(answers, "prompt_hash", "left").drop("prompt_hash")


def stub_model(responses: DataFrame, prompts: DataFrame, keys: list[str]) -> DataFrame:
    """Answers replayed from a table (keys, response, error), for tests; a prompt without one has an error."""
    joined = prompts.join(responses.select(*keys, "response", "error"), keys, "left")
    return joined.withColumn("error", F.when(F.col("response").isNull() & F.col("error").isNull(), "no answer recorded").otherwise(F.col("error")))


# --- the rules model: a rough checklist in place of a model; its answers are not those of one --------------

#: Per analyzer: what is looked for, its pattern (valid in Java and RE2), and the severity if it is found, or
#: with a dash before it if it is missing.
RULES = {
    "spec_check": (("brand named", r"(?i)\b(brand|model no)\b", "high"), ("narrow wording", r"(?i)\b(only|exclusively|must be made by)\b", "medium"), ("no equivalent allowed", r"(?i)\bor (an )?equivalent\b", "-low")),
    "lcca": (("upkeep", r"(?i)\b(maintenance|spare parts|warranty)\b", "-medium"), ("running cost", r"(?i)\b(energy|consumables|operating cost)\b", "-medium"), ("disposal", r"(?i)\b(disposal|end of life)\b", "-low")),
    "market_scope": (("budget", r"(?i)\b(budget|abc|contract price)\b", "-medium"), ("single supplier", r"(?i)\b(sole supplier|sole source)\b", "high")),
    "green": (("energy efficiency", r"(?i)\benergy[- ]efficien", "-low"), ("recycling", r"(?i)\brecycl", "-low"), ("emissions", r"(?i)\b(emission|carbon)", "-low")),
    "tatak_pinoy": (("domestic preference", r"(?i)\b(domestic|local) (preference|content|supplier)", "-medium"), ("foreign goods asked for", r"(?i)\bimported only\b", "high")),
    "compliance": (("mode of procurement", r"(?i)\b(bidding|shopping|negotiated|direct contracting)\b", "-low"), ("splitting of contracts", r"(?i)\bsplit(ting)? (of )?contracts?\b", "high")),
}
#: The list of a record that takes what the rules turn up, and the flag that says all is well.
_LISTS = {"spec_check": "issues", "lcca": "missing_considerations", "market_scope": "issues", "green": "missing_criteria", "tatak_pinoy": "compliance_issues", "compliance": "compliance_requirements"}


#: Words of which a text must hold one, in lower case, for a rule's pattern to match: they are looked for first, as most texts have none.
_WORDS = {
    "brand named": ("brand", "model no"), "narrow wording": ("only", "exclusively", "must be made by"), "no equivalent allowed": ("equivalent",),
    "upkeep": ("maintenance", "spare parts", "warranty"), "running cost": ("energy", "consumables", "operating cost"), "disposal": ("disposal", "end of life"),
    "budget": ("budget", "abc", "contract price"), "single supplier": ("sole s",),
    "energy efficiency": ("energy",), "recycling": ("recycl",), "emissions": ("emission", "carbon"),
    "domestic preference": ("domestic", "local"), "foreign goods asked for": ("imported only",),
    "mode of procurement": ("bidding", "shopping", "negotiated", "direct contracting"), "splitting of contracts": ("split",),
}


def _found(label: str, pattern: str, text: Column, lower: Column) -> Column:
    """Whether a rule's pattern matches a text, given in lower case too; a rule without words of its own is always tried."""
    held = [F.contains(lower, F.lit(w)) for w in _WORDS.get(label, ())]
    return reduce(or_, held) & text.rlike(pattern) if held else text.rlike(pattern)


def _answer(analyzer: str, found: Column) -> Column:
    """An analyzer's JSON answer: what the rules turn up, the worst severity, and neutral other fields."""
    hits = []
    for k, (label, _, severity) in enumerate(RULES[analyzer]):
        wanted = severity.startswith("-")
        shown = F.struct(F.lit(f"missing: {label}" if wanted else f"found: {label}").alias("label"), F.lit(severity.lstrip("-")).alias("severity"))
        hits.append(F.when(~found[k] if wanted else found[k], shown))
    hits = F.array_compact(F.array(*hits))
    worst = F.when(F.exists(hits, lambda h: h["severity"] == "high"), "high").when(F.exists(hits, lambda h: h["severity"] == "medium"), "medium").otherwise("low")
    fields = []
    for name, (kind, value, _) in RECORDS[analyzer].items():
        if name == _LISTS[analyzer]:
            made = F.transform(hits, lambda h: h["label"])
        elif name == "severity":
            made = worst
        elif kind == "boolean":
            made = worst == "low"
        elif kind == "string":
            made = F.lit(value)
        else:
            made = F.array().cast("array<string>")
        fields.append(made.alias(name))
    return F.to_json(F.struct(*fields))


def rules_responses(documents: DataFrame, thread: str, text: str) -> DataFrame:
    """(thread, analyzer, response, error) of the rules model, over whole texts in one scan; a pattern is tried once a text."""
    once = lambda x: F.explode(F.array(x))  # noqa: E731  by way of an array of one, so that it isn't made again wherever it is used
    whole = F.coalesce(F.col(text), F.lit(""))
    texts = documents.select(F.col(thread).alias("thread"), once(F.struct(whole.alias("text"), F.lower(whole).alias("lower"))).alias("t"))
    tried = F.struct(*[F.array(*[_found(label, pattern, F.col("t.text"), F.col("t.lower")) for label, pattern, _ in RULES[a]]).alias(a) for a in ANALYZERS])
    found = texts.select("thread", once(tried).alias("found"))
    each = [F.struct(F.lit(a).alias("analyzer"), _answer(a, F.col(f"found.{a}")).alias("response"), F.lit(None).cast("string").alias("error")) for a in ANALYZERS]
    return found.select(F.col("thread").alias(thread), F.explode(F.array(*each)).alias("a")).select(thread, "a.*")


# --- which model answers ------------------------------------------------------------------------------

#: From (documents, thread, text) to (thread, analyzer, response, error); a remote provider is one more entry.
Provider = Callable[[DataFrame, str, str], DataFrame]
PROVIDERS: dict[str, Provider] = {"rules": rules_responses}


def register_provider(name: str, provider: Provider) -> None:
    """Makes a provider known under a name; one of that name is replaced."""
    PROVIDERS[name.lower()] = provider


def provider_responses(documents: DataFrame, thread: str, text: str, settings: Settings | None = None) -> DataFrame:
    """The answers of the provider that ``settings.model_provider`` names, in any case of letters; by default the session's settings."""
    chosen = (settings or Settings.of(documents.sparkSession)).model_provider.lower()
    if chosen not in PROVIDERS:
        raise ValueError(f"no model provider {chosen!r}; there are {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[chosen](documents, thread, text)
