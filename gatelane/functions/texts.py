"""Column functions over evaluation texts, model names, word labels and tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: patterns, prompt wording, known names ----------------------
ANSWER_AJ = r"(?i)(?:answer(?:\sis)?:?\s*)([A-J])"
ANSWER_AD = r"(?i)(?:answer(?:\sis)?:?\s*)([A-D])"
# The historical A-D pattern has its backslashes doubled and so asks for literal ones.
ANSWER_AD_LITERAL = r"(?i)(?:answer(?:\\sis)?:?\\s*)([A-D])"
SUFFIX_COT = "Please solve this step-by-step, then provide your final answer in the format 'Answer: [letter]'."
SUFFIX_DIRECT = (
    "Please choose the correct answer from the options above. Provide your answer in the format 'Answer: [letter]'."
)
EMPTY_OPTION = "n/a"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE = r"\b\(?(\d{3})\)?[-.\s]?(\d{3})[-.\s]?(\d{4})\b"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
KNOWN_NAMES = [
    "John Smith", "Sarah Johnson", "Michael Brown", "Emily Davis",
    "David Wilson", "Anna Garcia", "James Miller", "Lisa Anderson",
]
MASKED_LABEL = -100
MAX_TOKENS = 512
# ------------------------------------------------------------------------------

# Characters that separate words, including the non-ASCII spaces.
SPACES = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
# The same set, which tells letters and digits apart by two ranges.
_CUT = r"[\x{0}-\x{20}\x{7F}-\x{10FFFF}&&" + SPACES[:-1] + "]+"
LETTERS = "ABCDEFGHIJ"


def lettered_options(options: Column) -> Column:
    """One ``X) option`` line per option; placeholders are left out but keep their letter."""
    letters = F.array(*[F.lit(c) for c in LETTERS])
    letter = lambda i: F.when(i < len(LETTERS), F.get(letters, i)).otherwise(
        F.raise_error(F.lit(f"a question has at most {len(LETTERS)} options")).cast("string")
    )
    lines = F.transform(
        options,
        lambda text, i: F.when(F.lower(text) != EMPTY_OPTION, F.concat(letter(i), F.lit(") "), text, F.lit("\n"))),
    )
    return F.array_join(lines, "")


def labelled_choices(labels: Column, texts: Column) -> Column:
    """One ``label) text`` line per choice, cut to the shorter list."""
    lines = F.zip_with(labels, texts, lambda a, b: F.concat(a, F.lit(") "), b, F.lit("\n")))
    return F.array_join(lines, "")


def question_prompt(question: Column, option_lines: Column, use_cot: bool = False) -> Column:
    suffix = SUFFIX_COT if use_cot else SUFFIX_DIRECT
    return F.concat(
        F.lit("Question: "), question, F.lit("\n\nOptions:\n"), option_lines, F.lit("\n\n" + suffix)
    )


def _answer(reply: Column, pattern: str, last: str) -> Column:
    stated = F.nullif(F.upper(F.regexp_extract(reply, pattern, 1)), F.lit(""))
    # Greedy prefix: the group is the last letter of the reply that qualifies.
    final = F.nullif(F.upper(F.regexp_extract(reply, rf"(?is)^.*([{last}])", 1)), F.lit(""))
    return F.coalesce(stated, final)


def answer_letter(reply: Column) -> Column:
    """Answer A-J: the stated answer, else the last such letter, else NULL."""
    return _answer(reply, ANSWER_AJ, "A-J")


def answer_letter_four(reply: Column, faithful: bool = False) -> Column:
    """Answer A-D. ``faithful`` uses the historical pattern that needs literal backslashes."""
    return _answer(reply, ANSWER_AD_LITERAL if faithful else ANSWER_AD, "A-D")


def is_correct(predicted: Column, answer: Column) -> Column:
    return F.coalesce(predicted == answer, F.lit(False))


def result_dir(model: Column, use_cot: Column) -> Column:
    """Directory name of one model's results."""
    return F.concat(F.replace(model, F.lit("/"), F.lit("_")), F.when(use_cot, "_cot").otherwise("_direct"))


def dir_approach(name: Column) -> Column:
    return F.when(F.contains(name, F.lit("_cot")), "cot").otherwise("direct")


def dir_model(name: Column) -> Column:
    """Model name from a result directory: approach removed, first underscore read as a slash."""
    bare = F.when(F.contains(name, F.lit("_cot")), F.replace(name, F.lit("_cot"), F.lit(""))).otherwise(
        F.replace(name, F.lit("_direct"), F.lit(""))
    )
    return F.regexp_replace(bare, "^([^_]*)_", "$1/")


def display_name(model: Column, approach: Column) -> Column:
    return F.concat(model, F.lit(":"), approach)


def short_display(name: Column) -> Column:
    return F.regexp_replace(name, ":direct$", "")


def base_model(name: Column, faithful: bool = False) -> Column:
    """Model of a display name. ``faithful`` cuts at the first colon, which loses model tags."""
    if faithful:
        return F.substring_index(name, ":", 1)
    return F.regexp_replace(name, ":(cot|direct)$", "")


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, _CUT), "")


def word_windows(text: Column, size: int) -> Column:
    """The whole text as consecutive pieces of at most ``size`` words, for scorers with short inputs."""
    pieces = lambda w: F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.size(w) / size).cast("int"), F.lit(1)) - 1),
        lambda i: F.array_join(F.slice(w, i * size + 1, size), " "),
    )
    return F.get(F.transform(F.array(words(text)), pieces), F.lit(0))


def mentions_known_name(text: Column) -> Column:
    """Any part of a known name occurs anywhere in the text."""
    parts = sorted({part for name in KNOWN_NAMES for part in name.split()})
    firsts = "".join(sorted({part[0] for part in parts}))  # looked at before any of the names
    return text.rlike(f"(?=[{firsts}])(?:{'|'.join(parts)})")


def word_pii_labels(text: Column, found: Column | None = None) -> Column:
    """0/1 per word: personal-data patterns, and capitalised words once a known name occurs.

    The name test reads the whole text, so it chooses between two rules once per row
    instead of standing inside the rule for every word. ``found`` has the words of the
    text where they are at hand. Every pattern has an at sign or a digit.
    """
    pattern = f"{EMAIL}|{PHONE}|{SSN}"
    personal = lambda w: w.rlike("[@0-9]") & w.rlike(pattern)
    named = lambda w: (personal(w) | (w.rlike(r"^\p{Lu}") & (F.length(w) > 1))).cast("int")
    plain = lambda w: personal(w).cast("int")
    found = words(text) if found is None else found
    return F.when(mentions_known_name(text), F.transform(found, named)).otherwise(F.transform(found, plain))


def pad_labels(labels: Column, length: int) -> Column:
    """Cut or zero-pad to ``length``."""
    zeros = F.array_repeat(F.lit(0), F.greatest(F.lit(length) - F.size(labels), F.lit(0)))
    return F.concat(F.slice(labels, 1, length), zeros)


def mask_labels(labels: Column, attention: Column) -> Column:
    """Positions without attention get the label that losses and scores skip."""
    return F.zip_with(labels, attention, lambda l, a: F.when(a == 0, MASKED_LABEL).otherwise(l))


def truncate_tokens(tokens: Column, max_length: int = MAX_TOKENS) -> Column:
    return F.slice(tokens, 1, max_length if max_length > 0 else MAX_TOKENS)


def seeded_key(seed: int, ident: Column) -> Column:
    """Total, partition-independent pseudo-random order of ids."""
    return F.concat(F.md5(F.concat(F.lit(f"{seed}:"), ident.cast("string"))), F.lit(":"), ident.cast("string"))


def seeded_pick(seed: int, slot: str, ident: Column, choices: int | Column) -> Column:
    """Pseudo-random integer in ``[0, choices)`` for one id and one named decision."""
    digest = F.md5(F.concat(F.lit(f"{seed}:{slot}:"), ident.cast("string")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % choices).cast("int")
