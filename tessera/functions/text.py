"""Column functions over text: words, templates, rewards, answers, log lines."""

from __future__ import annotations

import bz2
import lzma
import re
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(" \n\t\r\x0b\x0c"))


def words(x: Column) -> Column:
    return F.filter(F.split(x, r"\s+"), lambda w: w != "")


def number(x: Column) -> Column:
    """Double, null where the text isn't a plain number."""
    return F.when(x.rlike(NUMBER), x.try_cast("double"))


def approximate_tokens(x: Column) -> Column:
    return F.floor(F.size(words(x)) * 1.3).cast("long")


def next_power_of_two(n: Column, least: int = 1) -> Column:
    return F.greatest(F.lit(least), F.when(n <= 1, 1).otherwise(F.expr("1") * F.pow(F.lit(2.0), F.length(F.bin(n - 1))).cast("int")))


def template_names(template: Column) -> Column:
    """Names in {braces} of a template, each once, in order; doubled braces are text."""
    single = F.regexp_replace(template, r"\{\{|\}\}", "")
    return F.array_distinct(F.regexp_extract_all(single, F.lit(r"\{([A-Za-z0-9_]+)\}"), F.lit(1)))


def fill_template(template: str, values: dict[str, Column]) -> Column:
    """Placeholders {name} replaced by stripped values, in one pass: what a value holds isn't filled again. Doubled braces stand
    for single ones; names without a value stay as they are."""
    parts, done = [], 0
    for m in re.finditer(r"\{\{|\}\}|\{([A-Za-z0-9_]+)\}", template):
        parts.append(F.lit(template[done : m.start()]))
        if m[1] is None:
            parts.append(F.lit(m[0][0]))
        else:
            parts.append(strip(values[m[1]]) if m[1] in values else F.lit(m[0]))
        done = m.end()
    return F.concat(*parts, F.lit(template[done:]))


def has_names(template: str | None, names: list[str]) -> bool:
    found = re.findall(r"\{([A-Za-z0-9_]+)\}", re.sub(r"\{\{|\}\}", "", template or ""))
    return set(names) <= set(found)


def qa_conversation(question: Column, answer: Column, user: str | None = None, assistant: str | None = None, separator: str = "####") -> Column:
    """Messages of user and assistant. The user template needs {question}; the assistant template needs {reasoning} and {answer},
    and an answer that the separator splits in two; where one of these lacks, the raw text stands."""
    asked = fill_template(user, {"question": question}) if has_names(user, ["question"]) else question
    said = answer
    if has_names(assistant, ["reasoning", "answer"]):
        reasoning, final = split_once(answer, separator)
        said = F.when(reasoning.isNotNull(), fill_template(assistant, {"reasoning": reasoning, "answer": final})).otherwise(answer)
    message = lambda role, x: F.struct(F.lit(role).alias("role"), x.alias("content"))
    return F.array(message("user", asked), message("assistant", said))


def rendered(messages: Column, role: str = "role", content: str = "content") -> Column:
    """A chat as text: each message in tags of its role."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<"), m[role], F.lit(">"), m[content], F.lit("</"), m[role], F.lit(">\n"))), "")


def prompt_and_completion(messages: Column, role: str = "role") -> Column:
    """For each assistant message: what is rendered in front of it, and what its own rendering adds."""
    upto = lambda i: rendered(F.slice(messages, F.lit(1), i))
    every = F.transform(messages, lambda m, i: F.struct(m[role].alias("role"), upto(i).alias("prompt"), F.substring(upto(i + 1), F.length(upto(i)) + 1, F.lit(1 << 30)).alias("completion")))
    return F.filter(every, lambda x: x["role"] == "assistant")


def exact_format(x: Column, reason: tuple[str, str], answer: tuple[str, str]) -> Column:
    """What the answer tags hold, if the text is reasoning in tags and then an answer in tags, each not empty; else null. Only
    white space may stand around."""
    parts = [re.escape(t) for t in (*reason, *answer)]
    found = F.regexp_extract(x, rf"(?s)^\s*{parts[0]}.+?{parts[1]}.*?{parts[2]}(.+?){parts[3]}\s*$", 1)
    return F.nullif(found, F.lit(""))


def number_after(x: Column, tag: str) -> Column:
    """First run of digits and points behind a tag, as a number; null if there is none or it isn't a number."""
    found = F.regexp_extract(x, rf"(?s){re.escape(tag)}.*?([\d.]+)", 1)
    return number(found)


def number_reward(x: Column, tag: str, answer: Column) -> Column:
    """1.5 if the number behind the tag is the answer, else 0; null answers or texts give 0."""
    return F.when(number_after(x, tag) == number(strip(answer)), 1.5).otherwise(0.0)


def plain_number(x: Column) -> Column:
    """A number whose text may hold commas, dollar signs and blanks."""
    return number(F.translate(x, ", $", ""))


def response_flags(guess: Column, truth: Column, well_formed: Column) -> tuple[Column, Column, Column]:
    """(correct, within a tenth, well formed) of a response; without a number none of the three."""
    g, t = plain_number(guess), plain_number(truth)
    known = g.isNotNull() & t.isNotNull()
    near = F.try_divide(g, t).between(0.9, 1.1)
    return tuple(F.coalesce(known & x, F.lit(False)) for x in (g == t, near, well_formed))


def duration(seconds: Column) -> Column:
    """Seconds, minutes, hours, or days and hours, by size; tenths are cut, not rounded."""
    n = lambda x, unit: F.format_string(f"%.1f{unit}", F.floor(x * 10) / 10)
    days = F.format_string("%dd %dh", F.floor(seconds / 86400).cast("long"), F.floor(seconds % 86400 / 3600).cast("long"))
    return F.when(seconds < 60, n(seconds, "s")).when(seconds < 3600, n(seconds / 60, "m")).when(seconds < 86400, n(seconds / 3600, "h")).otherwise(days)


def parameters(x: Column) -> Column:
    """Map of the text `{k: v, k: v}`, values as text without quotes."""
    inner = F.regexp_replace(x, r"^\s*\{|\}\s*$", "")
    pairs = F.transform(F.split(inner, r",\s*"), lambda p: F.split(p, r":\s*", 2))
    bare = lambda t: F.regexp_replace(F.btrim(t), r"^['\"]|['\"]$", "")
    return F.map_from_entries(F.transform(F.filter(pairs, lambda p: F.size(p) == 2), lambda p: F.struct(bare(p[0]), bare(p[1]))))


def truth_value(x: Column) -> Column:
    """Boolean of a word; the query fails on others."""
    low = F.lower(x)
    known = F.when(low.isin("y", "yes", "t", "true", "on", "1"), True).when(low.isin("n", "no", "f", "false", "off", "0"), False)  # fixed values
    return F.when(x.isNull(), F.lit(None).cast("boolean")).when(known.isNotNull(), known).otherwise(F.raise_error(F.concat(F.lit("no truth value: "), x)))


def divisors(n: Column) -> Column:
    return F.filter(F.sequence(F.lit(1).cast("long"), n.cast("long")), lambda i: n % i == 0)


def tile_tokens(height: Column, width: Column, patches: int) -> Column:
    """Tokens of an image in height x width tiles of `patches` tokens: a frame of 3, the whole image, and the tiles with a
    separator each if there is more than one."""
    tiles = height * width
    return F.lit(3 + patches) + F.when(tiles > 1, tiles * (patches + 1)).otherwise(0)


def spliced_at(x: Column, marker: int, parts: Column) -> Column:
    """The i-th marker replaced by the i-th of the parts (an array of arrays); markers without a part go."""
    number = lambda i: F.size(F.filter(F.slice(x, F.lit(1), i + 1), lambda t: t == marker))
    return F.flatten(F.transform(x, lambda t, i: F.when(t == marker, F.coalesce(F.get(parts, number(i) - 1), F.array().cast("array<int>"))).otherwise(F.array(t))))


def with_images(prompt: Column, marker: str, images: Column) -> Column:
    """A prompt with as many image markers as there are images, the missing ones in front."""
    return F.concat(F.repeat(F.lit(marker), F.greatest(F.lit(0), images - occurrences(prompt, marker)).cast("int")), prompt)


def normalised_prompts(x: Column, kind: str, names: Column | None = None) -> Column:
    """Prompts as a list of texts: kind is text, texts, tokens or token_lists; tokens become names (an array) joined by blanks."""
    said = lambda tokens: F.array_join(F.transform(tokens, lambda t: F.get(names, t)), " ")
    known = {"text": lambda: F.array(x), "texts": lambda: x, "tokens": lambda: F.array(said(x)), "token_lists": lambda: F.transform(x, said)}
    if kind not in known:
        raise ValueError(f"prompts of kind {kind}")
    return known[kind]()


def split_once(x: Column, separator: str) -> tuple[Column, Column]:
    """Text in front of and behind the separator; nulls unless there is exactly one."""
    one = (F.length(x) - F.length(F.replace(x, F.lit(separator)))) == len(separator)
    return tuple(F.when(one, strip(F.split_part(x, F.lit(separator), F.lit(i)))) for i in (1, 2))


def hash_answer(x: Column) -> Column:
    return F.when(F.contains(x, F.lit("####")), strip(F.split_part(x, F.lit("####"), F.lit(2))))


def occurrences(x: Column, tag: str) -> Column:
    return F.floor((F.length(x) - F.length(F.replace(x, F.lit(tag)))) / len(tag))


def format_reward(x: Column, tags: list[str]) -> Column:
    """Half a point for each tag that occurs once, half a point less otherwise."""
    return sum((F.when(occurrences(x, t) == 1, 0.5).otherwise(-0.5) for t in tags), F.lit(0.0))


def answer_reward(guess: Column, answer: Column) -> Column:
    """3 equal, 1.5 equal but for blanks, 0.5 and 0.25 within 10 and 20 percent, else -1; not numbers -0.5; none 0."""
    g, a = number(strip(guess)), number(strip(answer))
    ratio = F.try_divide(g, a)
    return (
        F.when(guess.isNull(), 0.0).when(guess == answer, 3.0).when(strip(guess) == strip(answer), 1.5)
        .when(ratio.isNull(), -0.5).when(ratio.between(0.9, 1.1), 0.5).when(ratio.between(0.8, 1.2), 0.25).otherwise(-1.0)
    )


def choice_prompt(subject: Column, question: Column, choices: Column) -> Column:
    lines = F.transform(choices, lambda c, i: F.concat(F.char(i + 65), F.lit(". "), c))
    return F.concat(F.lit("Subject: "), F.replace(subject, F.lit("_"), F.lit(" ")), F.lit("\n"), question, F.lit("\n"), F.array_join(lines, "\n"))


def choice_letter(x: Column) -> Column:
    return F.nullif(F.upper(F.regexp_extract(x, r"(?i)(?:answer:|the answer is)\s*([A-D])", 1)), F.lit(""))


def stop_cut(x: Column, stops: list[str]) -> Column:
    """Text up to the first of several stop strings."""
    first = F.array_min(F.filter(F.array(*(F.instr(x, s) for s in stops)), lambda i: i > 0))
    return F.when(first.isNull(), x).otherwise(F.substring(x, F.lit(1), first - 1))


def hex_numbers(x: Column, size: int = 4) -> Column:
    """Signed little-endian whole numbers of `size` bytes each (4 or 8) of a hex text; a rest of fewer bytes is left out."""
    count = F.floor(F.length(x) / (2 * size)).cast("int")
    one = lambda i: F.concat(*(F.substring(x, i * (2 * size) + (2 * b + 1), F.lit(2)) for b in range(size - 1, -1, -1)))
    high, low = (lambda t: F.conv(F.substring(t, 1, 8), 16, 10).cast("long")), (lambda t: F.conv(F.substring(t, 9, 8), 16, 10).cast("long"))
    number = (lambda t: F.shiftleft(high(t), 32).bitwiseOR(low(t))) if size == 8 else (lambda t: F.when(high(t) > 2147483647, high(t) - 4294967296).otherwise(high(t)))
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: number(one(i)))).otherwise(F.array().cast("array<long>"))


def rouge(a: Column, b: Column, n: int = 1) -> Column:
    """F1 of the n-grams that two word arrays share, each as often as both have it; 0 where one has none."""
    grams = lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - (n - 1))), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))
    x, y = grams(a), grams(b)
    times = lambda w, g: F.size(F.filter(w, lambda h: h == g))
    both = F.aggregate(F.array_distinct(x), F.lit(0), lambda s, g: s + F.least(times(x, g), times(y, g)))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), both * 2.0 / (F.size(x) + F.size(y))).otherwise(0.0)


def compressed_sizes(x: Column) -> Column:
    """Bytes of a text under three general compressors, and the least of them. None of them is a built-in function; rows come in
    Arrow batches."""

    @F.pandas_udf("deflate int, bzip2 int, lzma int, least int")
    def sizes(texts: pd.Series) -> pd.DataFrame:
        raw = [(t or "").encode() for t in texts]
        out = pd.DataFrame({name: [len(f(r)) for r in raw] for name, f in (("deflate", zlib.compress), ("bzip2", bz2.compress), ("lzma", lzma.compress))}, dtype="int32")
        return out.assign(least=out.min(axis=1))

    return sizes(x)
