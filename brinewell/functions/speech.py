"""Transcripts: what is left of a speech recogniser's output, and whether it can be used; column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from brinewell.functions.text import fold, unaccented

#: Folded filler words, words of answers, words and phrases of sound tags.
FILLER = """
a e o ai ah aham alo amem bye eh entao ha haha hello hi hm hmm hum legal mm ne
obrigado obrigada obrigados oh oi ola so tchau thank thanks the uh uhum um valeu
you
""".split()
ANSWERS = """
sim nao isso mesmo ok okay ta bom beleza pode claro certo exato exatamente
perfeito combinado yes no yeah yep nope sure correct right
""".split()
SOUND_WORDS = """
music musica musicas song cancao singing cantando instrumental
applause aplausos aplauso laugh laughs laughing laughter risos riso risada
risadas rindo cough coughs coughing tosse tossindo sigh sighs sighing suspiro
suspiros suspirando barulho barulhos noise noises ruido ruidos silence silencio
beep beeps beeping bip bipe bell bells sino chirping chirp barking latido
latidos inaudible inaudivel indistinct unintelligible ininteligivel blank_audio
breathing respiracao respirando crying chorando choro static estatica
whistling assobio assobiando mumbling murmurio murmurando pigarro
""".split()
SOUND_PHRASES = (
    "pessoa falando", "pessoas falando", "speaking in foreign language",
    "speaking foreign language", "foreign language", "lingua estrangeira",
    "clears throat", "clearing throat", "blank audio", "no speech",
)
#: Credits that are a whole sentence, sign-offs that are a whole transcript, both normalised.
SENTENCE_CREDIT = (
    r"legendas? (?:por|pela|pelo)(?: .*)?"
    r"|transcricao e legendas?(?: .*)?"
    r"|(?:.* )?amara org(?: .*)?"
    r"|inscreva se no (?:meu |nosso )?canal(?: .*)?"
    r"|nao se esqueca de se inscrever(?: .*)?"
    r"|(?:please )?subscribe to (?:my|our|the) channel(?: .*)?"
    r"|(?:please )?(?:like and )?subscribe"
    r"|thank(?:s| you)(?: so| very)? much for watching"
    r"|thank(?:s| you) for watching"
    r"|obrigad[oa]s? por assistir(?:em)?"
)
WHOLE_SIGNOFF = (
    r"(?:muito )?obrigad[oa]s?(?: e)? ate a proxima(?: vez)?"
    r"|muito obrigad[oa]s?(?: a todos)?"
    r"|ate a proxima(?: vez)?"
    r"|thank you(?: so| very)? much"
)
ANSWER_MIN_SPEECH_MS, ANSWER_MIN_P = 400, 0.5
MUSIC = "[♪♫♬♭♮♯\U0001f3b5\U0001f3b6]+"
WORD = r"(?U)[^\W\d_]+(?:['’-][^\W\d_]+)*"
GROUPS = (r"\(([^()]*)\)", r"\(([^()]*)\)", r"\[([^\[\]]*)\]", r"\*([^*\n]+)\*")  # nested ones take two passes
TAG_TEXT = r"(?U)^[^\W\d]+(?:[\s'’-]+[^\W\d]+)*$"


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def _swapped(text: Column, pattern: str, gone) -> Column:
    """text with a blank instead of the matches that `gone` holds for; the rest as it was."""

    def swap(s: Column) -> Column:
        put = lambda g: F.when(gone(g), F.lit(" ")).otherwise(g)
        return F.array_join(F.zip_with(s["between"], F.transform(s["found"], put), lambda b, g: F.concat(b, F.coalesce(g, F.lit("")))), "")

    return let(text, lambda t: F.when(~t.rlike(pattern), t).otherwise(let(F.struct(F.split(t, pattern, -1).alias("between"), F.regexp_extract_all(t, F.lit(pattern), 0).alias("found")), swap)))


def is_sound_tag(inner: Column) -> Column:
    """Whether the text of a bracketed group names a sound: empty, or at most eight words, none with a digit, one of them a sound's."""

    def named(plain: Column) -> Column:
        words = F.filter(F.split(plain, r"\s+"), lambda w: w != "")
        return F.forall(F.array(words), lambda ws: (F.size(ws) <= 8) & (F.exists(ws, lambda w: w.isin(*SOUND_WORDS)) | F.concat(F.lit(" "), F.replace(plain, F.lit("_"), F.lit(" ")), F.lit(" ")).rlike(f" (?:{'|'.join(SOUND_PHRASES)}) ")))

    plain = F.replace(F.lower(unaccented(F.trim(inner))), F.lit("-"), F.lit(" "))
    return (F.trim(inner) == "") | (F.trim(inner).rlike(TAG_TEXT) & let(plain, named))


def cleaned(transcript: Column) -> Column:
    """A transcript without sound tags, music, credits and words of other scripts; empty if only a sign-off is left. Null counts as empty; decomposed accents stay so."""
    t = F.regexp_replace(F.translate(F.coalesce(transcript, F.lit("")), "\r\n", "  "), MUSIC, " ")
    for group in GROUPS:
        t = _swapped(t, group, lambda g: is_sound_tag(F.substr(g, F.lit(2), F.length(g) - 2)))
    sentences = F.filter(F.split(t, r"(?<=[.!?…])\s+", -1), lambda s: ~fold(s).rlike(f"^(?:{SENTENCE_CREDIT})$"))
    t = _swapped(F.array_join(sentences, " "), WORD, lambda w: w.rlike(r"[\p{L}&&[^\p{IsLatin}]]"))
    for pattern, put in ((r"\s+", " "), (r"\s+([,.;:!?…])", "$1"), (r"^[\s,.;:!?…-]+", ""), (r"([,;:])(?:\s*[,;:])+", "$1"), (r"^[\s,.;:!?…-]+$", "")):
        t = F.regexp_replace(t, pattern, put)
    return let(F.trim(t), lambda x: F.when(fold(x).rlike(f"^(?:{WHOLE_SIGNOFF})$"), "").otherwise(x))


def latin_words(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(WORD), 0), lambda w: ~w.rlike(r"[\p{L}&&[^\p{IsLatin}]]"))


def unusable_reason(text: Column, speech_ms: Column, lang_p: Column, min_speech_ms: int = 800, min_p: float = 0.8) -> Column:
    """Why a cleaned transcript can't be used, by the first rule that fits; null if it can.

    Nothing left; no Latin word; an answer with too little speech or an unsure
    language; too little speech; only filler, or a single word, with an unsure
    language. Null speech counts as none, null certainty as 0.
    """
    ms, p = F.coalesce(speech_ms, F.lit(0)), F.coalesce(lang_p, F.lit(0.0))

    def reason(t: Column, words: Column, content: Column) -> Column:
        answer = (F.size(content) > 0) & F.forall(content, lambda w: fold(w).isin(*ANSWERS))
        return (
            F.when(t == "", "nothing left")
            .when(F.size(words) == 0, "no latin text")
            .when(answer & (ms < ANSWER_MIN_SPEECH_MS), "too little speech for an answer")
            .when(answer & (p < ANSWER_MIN_P), "answer in an unsure language")
            .when(answer, None)
            .when(ms < min_speech_ms, "too little speech")
            .when((F.size(content) == 0) & (p < min_p), "only filler in an unsure language")
            .when((F.size(content) == 1) & (p < min_p), "a single word in an unsure language")
        )

    telling = lambda words: F.filter(words, lambda w: (F.length(w) > 1) & ~fold(w).isin(*FILLER))
    return let(F.coalesce(text, F.lit("")), lambda t: let(latin_words(t), lambda words: let(telling(words), lambda content: reason(t, words, content))))
