"""Column expressions on utterance text. Each takes and returns a Column; null text gives null or as stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of which a backchannel utterance is made.
BACKCHANNELS = ("yeah", "yea", "yep", "yup", "yes", "ya", "yah", "uh-huh", "uhhuh", "huh-uh", "um-hum", "umhum", "mm-hmm", "mm-hm", "mmhm", "mhm", "m-hm", "mm", "mmm", "hm", "hmm", "hmmm", "hum", "huh", "uh", "um", "er", "erm", "ah", "oh", "ooh", "aw", "okay", "ok", "right", "sure", "wow", "gosh")
#: Words and auxiliaries that open a question.
QUESTION_WORDS = ("what", "where", "when", "who", "whom", "whose", "why", "how", "which")
AUXILIARIES = ("do", "does", "did", "is", "are", "am", "was", "were", "can", "could", "will", "would", "shall", "should", "have", "has", "had", "may", "might", "must")
#: Discourse markers that may stand before a question.
MARKERS = ("so", "well", "and", "but", "or", "oh", "now", "then", "um", "uh", "okay", "ok", "yeah", "right", "like")
#: Filler words and phrases.
FILLERS = ("um", "uh", "like", "you know", "i mean", "so", "well", "i guess", "basically", "er")
#: Fixed value: first-person words.
FIRST_PERSON = r"(?i)(^|[^\p{L}\p{N}_])(i|my|me|mine|myself|we|our|us|ours|ourselves)($|[^\p{L}\p{N}_])"
ECHO_WORDS, ECHO_SHARE, ANECDOTE_WORDS = 6, 0.5, 5

_ENDS = r"""^["'.,!?;:()\[\]]+|["'.,!?;:()\[\]]+$"""
_PUNCTUATION_ENDS = r"^\p{Punct}+|\p{Punct}+$"


def words(text: Column) -> Column:
    """White-space words; no empty ones."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def is_bracket(word: Column) -> Column:
    return word.startswith("[") & word.endswith("]")


def tokens(text: Column) -> Column:
    """Lower-case words without whole-bracket tokens such as [noise]; i[t]- stays."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: (w != "") & ~is_bracket(w))


def strip_brackets(text: Column) -> Column:
    return F.array_join(F.filter(words(text), lambda w: ~is_bracket(w)), " ")


def is_backchannel(text: Column) -> Column:
    """1 if there is a word and all words, punctuation stripped off their ends, are backchannel words; brackets are words.

    The first word that is none ends the look at an utterance.
    """
    bare = lambda w: F.regexp_replace(w, _PUNCTUATION_ENDS, "")
    own = words(F.lower(text))
    return F.when(F.forall(own, lambda w: bare(w).isin(*BACKCHANNELS, "")) & F.exists(own, lambda w: bare(w) != ""), 1).otherwise(0)


def token_count(text: Column) -> Column:
    return F.when(text.isNull(), None).otherwise(F.size(tokens(text)))


def per_second(count: Column, seconds: Column) -> Column:
    """count / seconds; null without a positive duration."""
    return F.when(seconds > 0, count / seconds)


def vowel_groups(word: Column) -> Column:
    """Vowel groups of a lower-case word, one at least if it has a letter."""
    return F.when(word.rlike("[a-z]"), F.greatest(F.regexp_count(word, F.lit("[aeiouy]+")), F.lit(1))).otherwise(0)


def syllables(text: Column) -> Column:
    """Vowel groups of all tokens; the fallback without a pronunciation table."""
    return syllables_of(joined(tokens(text)))


def joined(token_list: Column) -> Column:
    """Tokens with a space between them, as the functions that count by a pattern take them."""
    return F.array_join(token_list, " ")


def syllables_of(line: Column) -> Column:
    """vowel_groups summed over the tokens of a line: no group reaches over a space, and a token of other letters only counts once."""
    return F.regexp_count(line, F.lit("[aeiouy]+")) + F.regexp_count(line, F.lit(r"(?<=^| )(?=[^ ]*[a-z])[^aeiouy ]+(?= |$)"))


def filler_hits(text: Column) -> Column:
    """Greedy left-to-right count of fillers, two-word phrases first; no word counts twice."""
    return filler_hits_of(joined(tokens(text)))


def filler_hits_of(line: Column) -> Column:
    phrases = sorted(FILLERS, key=lambda f: -len(f.split()))
    return F.regexp_count(line, F.lit(r"(?<=^| )(" + "|".join(phrases) + r")(?= |$)"))


def repetitions(token_list: Column) -> Column:
    """Struct of types, distinct tokens that occur at least twice, and pairs, the sum over distinct tokens of n * (n - 1) / 2.

    One fold over the sorted tokens: the k-th token of a run makes k - 1 pairs. Without a repeated token there is nothing to fold.
    """
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("types"), F.lit(0).cast("long").alias("pairs"))

    def step(a: Column, w: Column) -> Column:
        run = F.when(w == a["last"], a["run"] + 1).otherwise(1)
        return F.struct(w.alias("last"), run.alias("run"), (a["types"] + (run == 2).cast("int")).alias("types"), (a["pairs"] + run - 1).alias("pairs"))

    found = F.aggregate(F.sort_array(token_list), start, step)
    none = F.struct(F.lit(0).alias("types"), F.lit(0).cast("long").alias("pairs"))
    unique = F.size(F.array_distinct(token_list)) == F.size(token_list)
    return F.when(token_list.isNull(), None).when(unique, none).otherwise(F.struct(found["types"].alias("types"), found["pairs"].alias("pairs")))


def repeated_types(text: Column) -> Column:
    """Distinct tokens that occur at least twice."""
    return repetitions(tokens(text))["types"]


def repeated_pairs(text: Column) -> Column:
    """Sum over distinct tokens of n * (n - 1) / 2, n its count."""
    return repetitions(tokens(text))["pairs"]


def shared_pairs(text: Column, other: Column) -> Column:
    """Sum over tokens of the product of their counts in both texts; null if either is null.

    Both token lists are sorted as one, a token's own ones first: each of the other's then makes as many pairs as there were own ones.
    """
    t, o = tokens(text), tokens(other)
    side = lambda xs, k: F.transform(xs, lambda w: F.struct(w.alias("w"), F.lit(k).alias("k")))
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("own"), F.lit(0).cast("long").alias("pairs"))

    def step(a: Column, x: Column) -> Column:
        own = F.when(x["w"] == a["last"], a["own"]).otherwise(0)
        return F.struct(x["w"].alias("last"), (own + 1 - x["k"]).alias("own"), (a["pairs"] + own * x["k"]).alias("pairs"))

    both = F.sort_array(F.concat(side(t, 0), side(o, 1)))
    return F.when(F.arrays_overlap(t, o), F.aggregate(both, start, step)["pairs"]).when(t.isNotNull() & o.isNotNull(), F.lit(0).cast("long"))


def bracket_events(text: Column) -> Column:
    """Struct of counts: laughter, laughed_words, noise, vocalized_noise, other; the first kind that fits a token counts."""
    return bracket_events_of(F.filter(words(text), is_bracket))


def bracket_events_of(brackets: Column) -> Column:
    laugh = lambda w: w == "[laughter]"
    laughed = lambda w: w.startswith("[laughter-")
    noise, vocal = (lambda w: w == "[noise]"), (lambda w: w == "[vocalized-noise]")
    count = lambda f: F.size(F.filter(brackets, f))
    return F.struct(count(laugh).alias("laughter"), count(laughed).alias("laughed_words"), count(noise).alias("noise"), count(vocal).alias("vocalized_noise"), count(lambda w: ~laugh(w) & ~laughed(w) & ~noise(w) & ~vocal(w)).alias("other"))


def content_words(text: Column) -> Column:
    """Lower-case words without whole-bracket tokens, common punctuation stripped off their ends."""
    return F.filter(F.transform(F.filter(words(text), lambda w: ~is_bracket(w)), lambda w: F.lower(F.regexp_replace(w, _ENDS, ""))), lambda w: w != "")


def opens_question(first: Column) -> Column:
    return first.isin(*QUESTION_WORDS, *AUXILIARIES)


def question_flag(text: Column) -> Column:
    """1 if the first content word opens a question, else 0; null without one."""
    return question_flag_of(content_words(text))


def question_flag_of(content: Column) -> Column:
    first = F.get(content, F.lit(0))
    return F.when(first.isNotNull(), opens_question(first).cast("int"))


def question_flag_after_markers(text: Column) -> Column:
    """As question_flag with leading discourse markers skipped; 0 if nothing follows them, null without a content word."""
    return question_flag_after_markers_of(content_words(text))


def question_flag_after_markers_of(content: Column) -> Column:
    rest = F.get(F.filter(content, lambda w: ~w.isin(*MARKERS)), F.lit(0))
    return F.when(F.size(content) > 0, F.coalesce(opens_question(rest), F.lit(False)).cast("int"))


def echo_flag(question: Column, text: Column, earlier: Column) -> Column:
    """1 if a question of at most ECHO_WORDS content words has at least half of them in the earlier text; 0 without one."""
    c, p = content_words(text), content_words(F.coalesce(earlier, F.lit("")))
    share = F.size(F.filter(c, lambda w: F.array_contains(p, w))) / F.size(c)
    return F.when(question.isNull(), None).when((question == 1) & (F.size(c) <= ECHO_WORDS) & (F.size(p) > 0) & (share >= ECHO_SHARE), 1).otherwise(0)


def may_be_anecdote(text: Column) -> Column:
    """Long enough and first-person; the past-tense test needs tagged tokens."""
    bare = strip_brackets(text)
    return (F.size(words(bare)) >= ANECDOTE_WORDS) & bare.rlike(FIRST_PERSON)
