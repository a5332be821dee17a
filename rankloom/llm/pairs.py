"""Broken prompt and response pairs: empty, truncated, refused, copied answers and answers in another language.

Copies: the answer is compressed with its question as a zstandard dictionary, and the question with the answer; hardly anything may be
left either way, nor of the words that the question hasn't.
Refusals and languages: dictionaries of phrases and of words; the words of a language are learned, beyond the
common ones given here, from the pairs themselves. Truncation: a terminal-context model, learned from complete sentences,
says whether the last words of an answer can end one; lists must have the length they announce, brackets and code must be closed.
Words and contexts are counted over all pairs.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import blake2b

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

from rankloom.llm.batches import slices
from rankloom.session import cut
from rankloom.sources.records import strip_blank

DEFECTS = ["empty", "copy", "refusal", "language", "truncated"]
MIN_COUNT = 4
#: How hard the compressor works; pairs are short, so more gains nothing.
LEVEL = 3
PURITY = 0.9
#: A copy leaves at most so much of itself beyond its question, and of the question beyond itself.
NEW, UNSAID = 0.4, 0.5
#: Words of a copy that aren't those of the question, but for a letter, are bits of it: the dictionary leaves at most this share of their bytes.
NEW_WORDS = 0.5
#: Questions kept by a task at a time.
QUESTIONS = 10_000
#: Counts and words added up in a task before they are sent on.
KEPT = 200_000
#: A word that ends a sentence in fewer than this share of its uses, of which there are MIN_USES at least, ends no answer.
ENDS = 0.01
MIN_USES = 12
#: An answer in the question's language has at least this share of words that speak for it.
OWN_WORDS = 0.4

# Common words of languages, enough to label a question and to know an answer's language.
COMMON = {
    "en": "the of and to in is for with on that by this are was which who what when why how many does did has have from not at an it its be been will would there they their our we you your as or if but so because while under since than into after before during worth",
    "fr": "le la les des du de et est une un pour par dans que qui quel quelle quels quelles quand pourquoi combien avec sur ce cette ces au aux son sa ses leur nous vous il elle ne pas plus car depuis sous chaque été avoir être sont ont très après avant pendant selon dont où ainsi mais ou si",
    "de": "der die das den dem des und ist ein eine einen einem einer für mit von zu im in auf wer was wann warum wie viele welches welche welcher hat haben wird werden nicht auch als bei aus nach vor seit über unter sich sie er es wir ihr nur jede jeder alle weil dass sowie samt gemäß ohne während zwischen mehr",
    "es": "el la los las de del y es un una para por con en que quién qué cuál cuándo cuántos cuántas por al su sus se no más porque desde según sin cada este esta estos entre como ha han fue son está pero tras antes durante mediante sobre lo le les",
    "it": "il lo la gli le di del della dei delle degli e è un una per con in che chi quale quando perché quanti al alla ai alle dal dalla nel nella sul sulla non più anche come ha hanno sono stato ogni questo questa dopo prima durante senza tra fra suo sua loro ma se",
    "pt": "o a os as de do da dos das e é um uma para por com em no na nos nas que quem qual quando quantos ao à não mais porque desde sem cada este esta entre como foi são está mas após antes durante sobre se seu sua pelo pela",
    "nl": "de het een van en is voor met op in te dat die wie wat wanneer waarom hoe veel welke heeft hebben wordt worden niet ook als bij uit naar sinds over onder zich zij hij wij alleen elke alle omdat tussen meer dan aan door tot werd zijn deze dit",
    "pl": "i w z na do nie jest się że to o po od za dla przez przed kto co kiedy dlaczego ile jak który która które ma są był była oraz ale lub każdy bez między więcej niż ten ta te",
    "sv": "och i på av för med är en ett den det som att till från har inte vem vad när varför hur många vilken om vid efter före under över alla varje utan mellan mer än kan ska var blev sedan",
    "da": "og i på af for med er en et den det som at til fra har ikke hvem hvad hvornår hvorfor hvor mange hvilken om ved efter før under over alle hver uden mellem mere end kan skal var blev siden",
    "ro": "și în de la cu pentru pe este un o care ce cine când cât din nu mai se că sau dar prin fără fiecare între după înainte sunt are au fost",
    "cs": "a v z na do ne je se že to o po od za pro přes před kdo co kdy proč kolik jak který která které má jsou byl byla ale nebo každý bez mezi více než",
    "la": "et in est non ad cum sed quod qui quae ut ex ab per sunt esse aut vel",
}

# Answers that say nothing, compared without case, brackets, quotes and punctuation; no-break spaces stand inside them.
PLACEHOLDERS = set("""n/a na n.a none null nil nan undefined void empty blank tbd tba tbc todo fixme xxx xx placeholder pending unanswered unknown missing no answer no response no reply no data not available not applicable answer
response reply answer here your answer here insert answer here see above lorem ipsum test k.a keine antwort keine angabe sans réponse pas de réponse aucune réponse s/o sin respuesta
sin datos no disponible no aplica ninguno ninguna aucun aucune keine nichts rien nada to be determined to be done to be added coming soon""".replace("\n", " ").split(" "))

LONGEST = max(map(len, PLACEHOLDERS))

# Phrases that decline to answer or say that the answer isn't known or isn't in the sources.
_SPEAK = r"(?:answer|say|tell|help|assist|reply|respond|comment|give|provide|share|discuss|confirm|determine|find|speak|state|disclose|verify|comply|fulfil|advise|settle|guess|speculate)"
REFUSALS = [
    rf"\b(?:i|we)(?:\s+\w+)?\s*(?:can(?:no|['’])t|can not|am unable|are unable|am not able|are not able|could not|couldn['’]t|won['’]t|will not|must decline|decline|refuse|would rather not|(?:would )?prefer not|am not allowed|am not permitted|do not feel|don['’]t feel|may not|['’]m unable|['’]m not able|['’]d rather not)\b(?!\s+quote)",
    rf"\b(?:unable|not able|not possible|impossible|not in a position)\b[^.;]{{0,30}}\b{_SPEAK}\b",
    r"\b(?:can(?:no|['’])t|cannot|can not|could not|couldn['’]t) be (?:answered|determined|derived|given|found|settled|established|inferred|told|said)\b",
    r"\b(?:i|we)\s+(?:do not|don['’]t)\s+(?:know|have|hold|see|find|possess)\b",
    r"\bno idea\b|\bnot sure\b|\bno comment\b|\bguesswork\b|\bwho knows\b|\byour guess\b",
    r"\b(?:i|we)\s+(?:have|hold|see|find|found|know)\s+(?:no|nothing|none)\b|\bnothing\b[^.]{0,25}\b(?:i|we)\b[^.]{0,30}",
    r"\b(?:no|not enough|insufficient|not sufficient|lacks?|without)\b[^.;]{0,25}\b(?:information|answer|reply|response|evidence|details?|context|mention|data|statement)\b",
    r"\b(?:none|nothing)\b[^.;]{0,40}\b(?:passages?|sources?|documents?|excerpts?|context|texts?|files?|material|records?)\b|\bnone of (?:the|these|my)\b",
    r"\b(?:passages?|sources?|documents?|excerpts?|context|texts?|material|extracts?|pages?)\b[^.;]{0,45}(?:\b(?:not|no|never|silent|nothing)\b|n['’]t\b|\bstops? (?:before|short))[^.;]{0,40}(?:\b(?:mention|say|state|contain|cover|include|tell|name|touch|answer|comes? up|reply|list|address|information|about|subject|this|that|it)\w*\b)",
    r"\bnot (?:stated|mentioned|given|covered|included|contained|specified|available|provided|disclosed|found|shared|in the)\b|\b(?:is|are|was|were) (?:not|n['’]t) (?:shared|given|shown|provided|available|known|disclosed)\b",
    r"\boutside (?:of )?(?:what|my|the scope|our)\b|\bbeyond (?:what|my|the scope)\b|\bremains? (?:open|unanswered|unknown)\b|\bleft open\b|\bas an? (?:ai|language model|assistant)\b|\bdecline to\b|\bask (?:someone|somebody) else\b",
    r"\b(?:je|nous|j['’])\s*(?:ne|n['’])\s*\w+(?:\s+\w+)?\s+pas\b(?!\s+citer)|\bje préfère ne pas\b|\bimpossible de (?:vous|répondre|dire|le|se|savoir)\b|\bje (?:dois|suis)[^.]{0,25}(?:décliner|refuser|incapable|abstenir)\b|\b(?:je|j['’])\s*(?:refuse|m['’]abstiens|ignore)\b|\bjamais\b[^.]{0,30}\bréponse\b",
    r"\b(?:aucune?|pas|rien|ni|sans|ne|n['’])\b[^.;]{0,45}\b(?:réponse|informations?|sources?|extraits?|documents?|passages?|éléments?|renseignements?|données|mention\w*|contexte|textes?)\b",
    r"\b(?:sources?|extraits?|documents?|passages?|textes?|contexte|éléments?)\b[^.;]{0,30}\b(?:ne|n['’]|rien|muets?|aucune?|pas)\b|\bquestion reste (?:ouverte|sans)\b|\ben tant qu['’](?:ia|assistant|e? ?modèle|un)",
    r"\b(?:ich|wir)\b[^.;]{0,35}\b(?:nicht|keine?n?|leider|ablehnen|verweigern|nichts)\b|\b(?:kann|können|möchte|darf|will|weiß)\b[^.;]{0,25}\b(?:ich|wir)\b[^.;]{0,45}\b(?:nicht|keine?n?|nichts)\b(?!\s+zitieren)|\bmuss (?:ich|leider)[^.;]{0,30}(?:ablehnen|passen|verzichten)\b",
    r"\b(?:keine?n?|nichts|nicht|ohne|nirgends)\b[^.;]{0,45}\b(?:antwort\w*|angaben?|auskunft|informationen|quellen?|unterlagen|auszug|auszüge|ableiten|dokumente?\w*|textstellen?|hinweise?|daten)\b|\b(?:quellen?|unterlagen|auszug|auszüge|dokumente?n?|textstellen|passagen)\b[^.;]{0,45}\b(?:nicht|nichts|keine?n?|schweigen)\b|\bfrage\b[^.;]{0,15}\b(?:offen|unbeantwortet)\b|\bals (?:ki|sprachmodell|assistent)\b|\bliegen mir\b[^.;]{0,20}\bkeine",
    r"\b(?:no|ni)\s+(?:me\s+)?(?:puedo|podemos|sé|sabemos|dispongo|disponemos|tengo|tenemos|consta|es posible|encuentro|quiero|debo|deseo|corresponde|cuento)\b(?!\s+citar)|\bno lo sé\b|\b(?:prefiero|preferimos|mejor) no\b|\b(?:debo|tengo que) (?:rechazar|declinar|abstenerme)\b|\bme es imposible\b|\bimposible\b[^.;]{0,25}\b(?:responder|decir|saber|ayudar\w*|contestar)\b|\bme abstengo\b|\bdesconozco\b|\bdeclino\b",
    r"\b(?:ningun[ao]?|ningún|nada|no|sin|tampoco)\b[^.;]{0,45}\b(?:respuesta|información|fuentes?|extractos?|documentos?|pasajes?|datos|textos?|menciona\w*|contexto)\b|\b(?:fuentes?|extractos?|documentos?|pasajes?|textos?)\b[^.;]{0,40}\b(?:no|nada|ningun[ao]?|ninguna)\b|\bpregunta queda\b|\bcomo (?:ia|modelo|asistente)\b",
]
_REFUSAL = re.compile("|".join(f"(?:{p})" for p in REFUSALS), re.I)
# Sentences that go with a refusal and answer nothing.
_POLITE = re.compile(r"^\W*(?:(?:i['’ ]?a?m )?(?:so |very |truly |really )*(?:sorry|afraid)|my apologies|apologies|unfortunately|regrettably|please (?:contact|ask|consult|try|rephrase|check|see|reach|get|refer)|thank|je (?:suis|vous) (?:désolée?|prie)|désolée?|malheureusement|veuillez|merci|es tut mir leid|leider|bitte|entschuldigung|tut mir leid|lo siento|lamentablemente|lo lamento|por favor|disculpe|perdón|mis disculpas)\b", re.I)

_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_LETTERS = re.compile(r"[^\W\d_]+")
_LETTER = re.compile(r"[^\W_]")
_SPLIT = re.compile(r"[.!?…][\"'”’»)*\]]*\s+(?=[\"'“«(*\[¿¡]*[A-ZÀ-ÝŸŠŽ0-9¿¡])|\n+")
_SHORT_NUMBER = re.compile(r"(?<![\w.,])\d{1,2}\.$")
_STOPS, _CLOSERS = (".", "!", "?", "。", "！", "？"), "\"'”’»)*]_`"
_OPEN = re.compile(r"[,;:(\[{«“–—]$|\s[-&+/]$|(?<=\w)[-/]$")
_LEAD = re.compile(r"^\W*[^\W\d_]+(?:[ '’][^\W\dA-Z_]+){0,3}\s?:\s+")
_BOLD = re.compile(r"^(?:\*\*|__)[^*_\n]{1,120}(?:\*\*|__)\s*\n+")
_ITEM = re.compile(r"^[ \t]*(?:\d{1,4}[.)]|[-+*•])[ \t]+\S", re.M)
# Number words, for lists that announce their length.
NUMBERS = {w: n for n, ws in {2: "two deux zwei dos due twee", 3: "three trois drei tres tre drie três", 4: "four quatre vier cuatro quattro quatro", 5: "five cinq fünf cinco cinque vijf", 6: "six six sechs seis sei zes", 7: "seven sept sieben siete sette", 8: "eight huit acht ocho otto", 9: "nine neuf neun nueve nove", 10: "ten dix zehn diez dieci"}.items() for w in ws.split()}
_ANNOUNCED = re.compile(rf"\b({'|'.join(sorted(NUMBERS, key=len, reverse=True))}|\d{{1,4}})\s+(?:[^\W\d_]+\s+){{0,2}}?(?:steps?|points?|items?|reasons?|things?|parts?|conditions?|cases?|stages?|rules?|options?|étapes?|points|raisons?|éléments?|cas|schritte|punkte|gründe|dinge|teile|pasos|puntos|razones|cosas|partes|motivos)\b[^\n:]{{0,60}}:[ \t]*(?=\n)", re.I)
_DECLARED = re.compile(rf"\b({'|'.join(sorted(NUMBERS, key=len, reverse=True))}|\d{{1,4}})\b[^\n:.]{{0,60}}:[ \t]*\n(?=[ \t]*(?:1[.)]|[-+*•])[ \t])", re.I)
_MONTHS = r"(?:jan|feb|mar|apr|may|mai|jun|jul|aug|sep|oct|okt|nov|dec|dez|janv|févr|avr|juin|juil|août|déc|ene|abr|ago|dic|mär)[^\W\d_]*\.?"
# What stands before and after a number over 20 that is a year, a date, an amount or part of a name, not the length of a list.
_NO_COUNT = re.compile(rf"(?:[-–/.,#$€£]|\b(?:in|since|until|till|by|from|of|on|at|to|and|years?|en|depuis|de|le|du|im|seit|bis|am|von|jahr|desde|el|del|{_MONTHS})\s+)$", re.I)
_NO_LENGTH = re.compile(rf"\s*(?:[^\s\w]|{_MONTHS}\s|(?:percent|per|crowns?|kronen|couronnes?|coronas|euros?|dollars?|years?|months?|weeks?|days?|hours?|minutes?)\b)", re.I)


def _counts(pattern: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    """(length, offset of the list) of every list that a text announces."""
    at = 0
    while m := pattern.search(text, at):
        n = NUMBERS.get(m[1].lower()) or int(m[1])
        if n > 20 and (_NO_COUNT.search(text[max(0, m.start() - 20) : m.start()]) or _NO_LENGTH.match(text, m.end(1))):
            at = m.end(1)
        else:
            yield n, m.end()
            at = m.end()


def sentences(text: str) -> list[str]:
    """The sentences of a text; a day of the month with its full stop ends none."""
    out, start = [], 0
    for m in _SPLIT.finditer(text):
        line = m[0][0] == "\n"
        piece = text[start : m.start() + (not line)]
        if not line and "\n" not in m[0] and _SHORT_NUMBER.search(piece):
            continue
        if piece.strip():
            out.append(piece.strip())
        start = m.end()
    if text[start:].strip():
        out.append(text[start:].strip())
    return out


def _stopped(text: str) -> bool:
    """The text ends with a full stop or another mark of an end, quotes and brackets after it aside."""
    return text.rstrip(_CLOSERS).endswith(_STOPS)


@dataclass
class Model:
    """Word dictionaries by language, and the contexts that hardly ever end a sentence."""

    languages: dict[str, str] = field(default_factory=dict)
    known: set[str] = field(default_factory=set)
    sorted: list[str] = field(default_factory=list)
    inner: set[tuple[str, ...]] = field(default_factory=set)
    _fitting: dict[str, set[str]] = field(default_factory=dict)
    _asked: dict[str, "Asked"] = field(default_factory=dict)

    def fitting(self, lang: str) -> set[str]:
        """The words that speak for a language."""
        if lang not in self._fitting:
            self._fitting[lang] = {w for w, of in self.languages.items() if of == lang} | {w for w, of in _COMMON.items() if lang in of and w not in self.languages}
        return self._fitting[lang]

    def asked(self, question: str) -> "Asked":
        """What is read from a question once, however many answers it has; a bounded number of questions is kept."""
        if question not in self._asked:
            if len(self._asked) >= QUESTIONS:
                self._asked.clear()
            self._asked[question] = Asked(question, self)
        return self._asked[question]


_COMMON: dict[str, set[str]] = defaultdict(set)
for _lang, _words in COMMON.items():
    for _w in _words.split():
        _COMMON[_w].add(_lang)


def common_language(words: list[str]) -> str | None:
    """The language with clearly most common words, by the given dictionaries alone."""
    scores: Counter[str] = Counter()
    for w in words:
        for lang in _COMMON.get(w, ()):
            scores[lang] += 1 / len(_COMMON[w])
    best = scores.most_common(2)
    return best[0][0] if best and (len(best) == 1 or best[0][1] > best[1][1]) else None


def _lower(text: str) -> list[str]:
    return [w.lower() for w in _LETTERS.findall(text)]


def tokens(sentence: str, model: Model) -> list[str]:
    """Words in lower case; numbers as 9, runs of names as N."""
    out: list[str] = []
    for w in _WORD.findall(sentence):
        low = w.lower()
        t = "9" if w[0].isdigit() else low if w[0].islower() or low in model.languages or low in _COMMON else "N"
        if t != "N" or not out or out[-1] != "N":
            out.append(t)
    return out


class Asked:
    """A question as answers are compared with it."""

    def __init__(self, question: str, model: Model):
        self.words = _WORD.findall(question)
        self.have = {w.lower() for w in self.words}
        self.small = {w for w in _LETTERS.findall(question) if w[0].islower()}
        self.squeezed = _squeezed(self.words)
        letters = _LETTERS.findall(question)
        self.latin = all(w[0] < "\u0250" for w in letters)
        self.script = Counter(map(_script, letters)).most_common(1)[0][0] if letters else None
        best = _scores([w.lower() for w in letters], model).most_common(1)
        self.language = best[0][0] if best else None
        self.own = model.fitting(self.language) | self.small if best else set()
        self.helped: zstandard.ZstdCompressor | None = None


#: (questions with a word, those of them that have it in small letters) by word and language; questions of a language at the empty word.
Words = dict[tuple[str, str], list[int]]


def _count(words: Words, lang: str, forms: Iterable[str]) -> None:
    """Adds a question, with the answers that fit it: a word counts once for each question, for a name of one question is no word of its language."""
    forms = set(forms)
    for w in {"", *(f.lower() for f in forms)}:
        n = words[w, lang]
        n[0] += 1
        n[1] += w in forms


def _tells(word: str, n: int, small: int, seen: int, rarity: float) -> bool:
    """A word that seen questions have, n of them in one language, is of that language; capitalised ones need more evidence, for they may be names."""
    return len(word) > 1 and n >= MIN_COUNT and (2 * small >= seen and n >= PURITY * seen or n >= 0.97 * seen and n * rarity >= 12)


def _rarities(langs: dict[str, int]) -> dict[str, float]:
    return {lang: math.log(sum(langs.values()) / n) for lang, n in langs.items()}


def _learn(words: Words) -> dict[str, str]:
    """Words that occur, over different questions, almost only in one language."""
    rarity = _rarities({lang: n for (w, lang), (n, _) in words.items() if not w})
    by_word: dict[str, list[tuple[int, str, int]]] = defaultdict(list)
    for (w, lang), (n, small) in words.items():
        by_word[w].append((n, lang, small))
    best = {w: (*max(of), sum(n for n, _, _ in of), sum(small for _, _, small in of)) for w, of in by_word.items()}
    return {w: lang for w, (n, lang, _, seen, small) in best.items() if _tells(w, n, small, seen, rarity[lang])}


def _telling(text: str, model: Model) -> list[str]:
    """The different words of a text that tell its language: those in small letters, and nouns of the dictionary."""
    body = re.sub(r"```.*?(?:```|$)", " ", text, flags=re.S) if "```" in text else text
    known = model.languages
    return list(dict.fromkeys(low for w in _LETTERS.findall(body) for low in (w.lower(),) if low in known or not w[0].isupper()))


def _fits(word: str, lang: str, model: Model) -> bool:
    return model.languages.get(word) == lang or word not in model.languages and lang in _COMMON.get(word, ())


def _share(words: list[str], asked: Asked) -> float:
    return sum(map(asked.own.__contains__, words)) / len(words) if words else 1.0


class _Question:
    """A question whose language is known by its common words, and the word forms of it and of the answers that fit it."""

    def __init__(self, question: str):
        self.lang = common_language(_lower(question))
        self.forms = set(_LETTERS.findall(question))
        self.small = {w for w in self.forms if w[0].islower()}

    def add(self, answer: str, model: Model) -> None:
        own, words = model.fitting(self.lang), _telling(answer, model)
        if sum(w in own or w in self.small for w in words) >= 0.5 * len(words):
            self.forms.update(_LETTERS.findall(answer))


def _inside(answer: str) -> set[str]:
    """The words in small letters that the answer doesn't end with."""
    return {w for w in _LETTERS.findall(answer) if w.islower() and not answer.endswith(w)}


def _contexts(answer: str, model: Model) -> tuple[list[tuple[str, ...]], list[tuple[str, ...]]]:
    """The contexts of one word and of two in the sentences of an answer, and those of them that end one; where none ends, the last ones are left out."""
    uses, ends = [], []
    for s in sentences(answer):
        t = tokens(s, model)
        if not t:
            continue
        uses += zip(t[:-1])
        uses += zip(["^", *t[:-2]], t[:-1])
        if _stopped(s):
            ends += [(t[-1],), (t[-2] if len(t) > 1 else "^", t[-1])]
    return uses + ends, ends


def _hardly(uses: int, ends: int) -> bool:
    return uses >= MIN_USES and ends / uses < ENDS


def _shut(contexts: Iterable[tuple[str, ...]]) -> set[tuple[str, ...]]:
    """Contexts of two words count where the last word alone hardly ends a sentence either."""
    hardly = set(contexts)
    return {c for c in hardly if c[-1:] in hardly}


def fit(questions: list[str], answers: list[str]) -> Model:
    """Dictionaries and terminal contexts from all given pairs, defective ones among them; fit_all does the same for a table."""
    model = Model()
    asked = {q: _Question(q) for q in questions}
    for learned in (False, True):
        if learned:
            for q, a in zip(questions, answers):
                if asked[q].lang:
                    asked[q].add(a, model)
        words: Words = defaultdict(lambda: [0, 0])
        for q in asked.values():
            if q.lang:
                _count(words, q.lang, q.forms)
        model.languages = _learn(words)
        model._fitting.clear()
    inside: Counter[str] = Counter()
    uses: Counter = Counter()
    ends: Counter = Counter()
    for a in answers:
        inside.update(_inside(a))
        used, ended = _contexts(a, model)
        uses.update(used)
        ends.update(ended)
    model.known = {w for w, n in inside.items() if n >= 2}
    model.sorted = sorted(model.known)
    model.inner = _shut(c for c, n in uses.items() if _hardly(n, ends[c]))
    return model


def is_empty(answer: str | None) -> bool:
    text = strip_blank(answer or "")
    first = _LETTER.search(text)
    if not first:
        return not re.search(r"[\U0001f300-\U0001faff]", text)
    if len(text) - first.start() > 2 * LONGEST and len(_WORD.findall(text[: 8 * LONGEST])) > 8:
        return False  # more words than any placeholder
    bare = re.sub(r"^[\W_]+|[\W_]+$", "", text).lower()
    return re.sub(r"\s+", "\xa0", bare) in PLACEHOLDERS or bare in PLACEHOLDERS


def _squeezed(words: list[str]) -> bytes:
    return " ".join(words).lower().encode()


def _compressor(dictionary: bytes | None = None) -> zstandard.ZstdCompressor:
    extra = {"dict_data": zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)} if dictionary else {}
    return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, **extra)


@lru_cache(maxsize=1)
def _plain() -> tuple[zstandard.ZstdCompressor, int]:
    plain = _compressor()
    return plain, len(plain.compress(b""))


def _left(helped: zstandard.ZstdCompressor, text: bytes) -> float:
    """Bytes of a text that a dictionary doesn't explain, as a share of its own compressed length."""
    plain, frame = _plain()
    return (len(helped.compress(text)) - frame) / max(1, len(plain.compress(text)) - frame)


def left_over(question: str, answer: str) -> float:
    """The share of the answer that its question as a dictionary doesn't explain."""
    q, a = _squeezed(_WORD.findall(question)), _squeezed(_WORD.findall(answer))
    return _left(_compressor(q), a) if q and a else 1.0


def _near(word: str, others: set[str]) -> bool:
    """word with one letter missing, added, changed or swapped is one of others."""
    if word in others:
        return True
    if len(word) < 4 or any(c.isdigit() for c in word):
        return False
    for o in others:
        if abs(len(o) - len(word)) <= 1:
            i = 0
            while i < min(len(o), len(word)) and o[i] == word[i]:
                i += 1
            if o[i + 1 :] == word[i + 1 :] or o[i:] == word[i + 1 :] or o[i + 1 :] == word[i:] or o[i : i + 2] == word[i : i + 2][::-1] and o[i + 2 :] == word[i + 2 :]:
                return True
    return False


def is_copy(asked: Asked, answer: str) -> bool:
    """The answer says the question again: neither leaves much when compressed with the other, and its other words leave as little.

    A few words and a colon before it (you asked: ...) say nothing. A word of the question alone may be its answer: it
    doesn't explain the question.
    """
    lead = _LEAD.match(answer)
    words = _WORD.findall(answer[lead.end() :] if lead else answer)
    said = {w.lower() for w in words}
    if len(words) < 2 or 2 * len(said & asked.have) < len(said):
        return False  # most words are new: compression can't explain them
    if asked.helped is None:
        asked.helped = _compressor(asked.squeezed)
    answer_ = _squeezed(words)
    if _left(asked.helped, answer_) > NEW or _left(_compressor(answer_), asked.squeezed) > UNSAID:
        return False
    rest = _squeezed([w for w in words if not _near(w.lower(), asked.have)])
    return len(asked.helped.compress(rest)) - _plain()[1] <= NEW_WORDS * len(rest)


# Words without which no phrase of REFUSALS holds (apostrophes part words).
_TRIGGERS = set("""not no cannot t unable impossible nothing none guesswork knows guess insufficient lack lacks without never silent stop stops outside beyond open unanswered unknown ai assistant model decline refuse someone somebody
pas n ne aucun aucune rien ni sans muet muets jamais abstiens ignore décliner refuser incapable abstenir reste tant nicht kein keine keinen keinn nichts leider ablehnen verweigern ohne nirgends passen verzichten schweigen offen unbeantwortet
ki sprachmodell assistent imposible abstengo desconozco declino ningun ninguno ninguna ningún nada sin tampoco queda rechazar declinar abstenerme ia modelo asistente""".split())


def is_refusal(answer: str) -> bool:
    """Every sentence declines, says that nothing is known, or is a courtesy; one at least declines."""
    if _TRIGGERS.isdisjoint(_lower(answer)):
        return False
    declined = False
    for s in sentences(re.sub(r"^[^:\n]{1,60}:\s+(?=(?:I|My|We|Je|Ich|No|Lo|Leider|Désolé|Sorry)\b)", "", answer)):
        if _REFUSAL.search(s):
            declined = True
        elif not _POLITE.search(s):
            return False
    return declined


def _scores(words: list[str], model: Model) -> Counter:
    scores: Counter[str] = Counter()
    for w in words:
        if lang := model.languages.get(w):
            scores[lang] += 1
        else:
            for lang in _COMMON.get(w, ()):
                scores[lang] += 1 / len(_COMMON[w])
    return scores


def _script(word: str) -> str:
    """The writing system of a word, by its first letter."""
    return "LATIN" if word[0] < "\u0250" else unicodedata.name(word[0], "?").split(" ")[0].split("-")[0]


def other_language(asked: Asked, answer: str, model: Model) -> bool:
    """The answer's words aren't of the question's language.

    Only words in small letters tell a language (in German nouns of the dictionary too), so names and numbers don't. Words of
    the question, of its language's dictionary or common in it speak for it. An answer of four different words or more is in another
    language if few of them do; a shorter one if none does and the dictionaries know one of another language.
    """
    words = _telling(answer, model)
    if not words or asked.script is None:
        return False
    if not asked.latin or max(answer) >= "\u0250":
        scripts = Counter(map(_script, words))
        if scripts.most_common(1)[0][0] != asked.script and scripts[asked.script] < 0.4 * len(words):
            return True
    own = asked.language
    if own is None:
        return False
    share = _share(words, asked)
    if share > 2 / 3:
        return False  # no language can have half as many words again
    others = {lang: sum(map(model.fitting(lang).__contains__, words)) for lang in COMMON if lang != own}
    best = max(others.values())
    if len(words) >= 4:
        return share < OWN_WORDS or best >= 1.5 * share * len(words) and best - share * len(words) >= 3
    learned = sum(model.languages.get(w, own) != own for w in words)
    return not share and (learned > 0 or sum(any(_fits(w, lang, model) for lang in COMMON) for w in words) >= 2)


def is_truncated(asked: Asked, answer: str, model: Model) -> bool:
    text = strip_blank(answer)
    if text.count("```") % 2:
        return True
    body = _BOLD.sub("", text) or text
    if ":" in body and "\n" in body:
        for wanted, at in (*_counts(_ANNOUNCED, body), *_counts(_DECLARED, body)):
            if len(_ITEM.findall(body[at:])) < wanted:
                return True
    if text.endswith("```"):
        return False
    if _OPEN.search(text[-3:]):
        return True
    if body.count("(") > body.count(")") and not re.search(r"\d\)", body[body.rfind("(") :]):
        return True
    if _stopped(text):
        return False
    parts = sentences(body)
    last = parts[-1] if parts else body
    said = _WORD.findall(last)
    if not said:
        return False
    end = said[-1]
    # A name that goes on in the question, or a word that is only the start of one there.
    named = asked.words
    for i, w in enumerate(named[1:], 1):
        if len(said) > 1 and named[i - 1] == said[-2] and w[0].isupper():
            if w == end and i + 1 < len(named) and named[i + 1][0].isupper() or w != end and w.startswith(end):
                return True
    if end.islower() and len(said) > 1 and end not in model.known and end not in model.languages and end not in _COMMON:
        k = bisect_left(model.sorted, end)
        if k < len(model.sorted) and model.sorted[k].startswith(end):
            return True  # the beginning of a known word
    if len(parts) > 1 and _stopped(parts[-2]):
        return True
    t = tokens(last, model)
    if len(t) < 2 or not end.islower():
        return False  # a name or a number alone may be the answer
    return (t[-2], t[-1]) in model.inner


def defect(question: str | None, answer: str | None, model: Model) -> str | None:
    """The defect of a pair, or None."""
    if is_empty(answer):
        return "empty"
    asked, a = model.asked(strip_blank(question or "")), strip_blank(answer)
    if is_copy(asked, a):
        return "copy"
    if is_refusal(a):
        return "refusal"
    if other_language(asked, a, model):
        return "language"
    return "truncated" if is_truncated(asked, a, model) else None


SCHEMA = "pair_id string, defect string, flagged boolean"


def _label(model: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(batches, "answer"):
            found = [defect(q, a, model) for q, a in zip(pdf["question"], pdf["answer"])]
            yield pd.DataFrame({"pair_id": pdf["pair_id"], "defect": found, "flagged": pdf["truncated"]})

    return run


COUNTS = "word string, kind string, n bigint, m bigint"


def _rows(counts: Iterable[tuple[str, str, int, int]]) -> pd.DataFrame:
    return pd.DataFrame(list(counts), columns=["word", "kind", "n", "m"]).astype({"n": "int64", "m": "int64"})


def _sent(words: Words) -> pd.DataFrame:
    """The counts as rows, and none left."""
    out = _rows((w, lang, n, small) for (w, lang), (n, small) in words.items())
    words.clear()
    return out


def _question_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words of different questions."""
    words: Words = defaultdict(lambda: [0, 0])
    for pdf in slices(batches, "question"):
        for q in map(_Question, pdf["question"]):
            if q.lang:
                _count(words, q.lang, q.forms)
        if len(words) > KEPT:
            yield _sent(words)
    yield _sent(words)


FORMS = "question binary, lang string, forms string"


def _forms(model: Model):
    """The word forms of a question and its answers, once for many answers of a task; a digest stands for the question."""

    def sent(asked: dict[str, _Question]) -> pd.DataFrame:
        known = [(blake2b(text.encode(), digest_size=16).digest(), q.lang, " ".join(q.forms)) for text, q in asked.items() if q.lang]
        asked.clear()
        return pd.DataFrame(known, columns=["question", "lang", "forms"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked: dict[str, _Question] = {}
        size = 0
        for pdf in slices(batches, "answer"):
            for text, a in zip(pdf["question"], pdf["answer"]):
                q = asked.get(text)
                if q is None:
                    q = asked[text] = _Question(text)
                    size += len(q.forms) + 1
                if q.lang:
                    size -= len(q.forms)
                    q.add(a, model)
                    size += len(q.forms)
                if size > KEPT:
                    yield sent(asked)
                    size = 0
        yield sent(asked)

    return run


def _pair_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Words of questions whose rows follow each other."""
    words: Words = defaultdict(lambda: [0, 0])
    at, of, forms = None, "", set()
    for pdf in batches:
        for question, lang, some in zip(pdf["question"], pdf["lang"], pdf["forms"]):
            if question != at:
                if at is not None:
                    _count(words, of, forms)
                at, of, forms = question, lang, set()
            forms.update(some.split(" "))
        if len(words) > KEPT:
            yield _sent(words)
    if at is not None:
        _count(words, of, forms)
    yield _sent(words)


def _answer_words(model: Model):
    """Words inside answers, and contexts with how often they end a sentence."""

    def sent(inside: Counter, uses: Counter, ends: Counter) -> pd.DataFrame:
        out = _rows([*((w, "inside", n, 0) for w, n in inside.items()), *((" ".join(c), "context", n, ends[c]) for c, n in uses.items())])
        for counts in (inside, uses, ends):
            counts.clear()
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = inside, uses, ends = Counter(), Counter(), Counter()
        for pdf in slices(batches, "answer"):
            for a in pdf["answer"]:
                inside.update(_inside(a))
                used, ended = _contexts(a, model)
                uses.update(used)
                ends.update(ended)
            if len(inside) + len(uses) > KEPT:
                yield sent(*counts)
        yield sent(*counts)

    return run


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("word", "kind").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def _learned(words: DataFrame, langs: dict[str, int]) -> dict[str, str]:
    """As _learn, from a table of counts: only words that tell a language come to the driver."""
    if not langs:
        return {}
    rarity = F.create_map(*[F.lit(x) for pair in _rarities(langs).items() for x in pair])
    by_word = words.where("word != ''").groupBy("word").agg(F.max(F.struct("n", "kind")).alias("best"), F.sum("n").alias("seen"), F.sum("m").alias("small"))
    n, lang, seen = F.col("best.n"), F.col("best.kind"), F.col("seen")
    plain = (2 * F.col("small") >= seen) & (n >= F.lit(PURITY) * seen)
    rare = (n >= F.lit(0.97) * seen) & (n * rarity[lang] >= 12)
    return {r["word"]: r["lang"] for r in by_word.where((F.length("word") > 1) & (n >= MIN_COUNT) & (plain | rare)).select("word", lang.alias("lang")).collect()}


def fit_all(pairs: DataFrame) -> Model:
    """The models fitted on all pairs with a question and an answer, the same ones however the rows are partitioned.

    The pairs are read three times: for the words of the questions, for those of the answers that fit them, and for contexts. Counts are
    added up in the tasks and by aggregates; the driver gets the dictionaries, which grow with the vocabulary.
    """
    model = Model()
    filled = pairs.where("question is not null and answer is not null").select("question", "answer")
    words = cut(_summed(filled.select("question").distinct().mapInPandas(_question_words, COUNTS)))
    langs = {r["kind"]: r["n"] for r in words.where("word = ''").collect()}
    model.languages = _learned(words, langs)
    forms = filled.mapInPandas(_forms(model), FORMS).repartition("question").sortWithinPartitions("question")
    model.languages = _learned(_summed(forms.mapInPandas(_pair_words, COUNTS)), langs)
    model._fitting.clear()
    hardly = (F.col("n") >= MIN_USES) & (F.col("m") / F.col("n") < ENDS)
    answers = _summed(filled.mapInPandas(_answer_words(model), COUNTS)).where((F.col("kind") == "inside") & (F.col("n") >= 2) | (F.col("kind") == "context") & hardly)
    found = answers.select("word", "kind").collect()
    model.known = {r["word"] for r in found if r["kind"] == "inside"}
    model.sorted = sorted(model.known)
    model.inner = _shut(tuple(r["word"].split(" ")) for r in found if r["kind"] == "context")
    return model


def label(pairs: DataFrame, model: Model | None = None) -> DataFrame:
    """pair_id, defect (null: none) and the flag of every pair of (pair_id, question, answer, truncated); other columns are ignored.

    A null or blank answer is empty whatever the question; a null question has no language and can't be copied; repeated
    rows repeat. The flag is carried along and decides nothing. Whole answers are read. Without a model, one is fitted on all pairs.
    """
    rows = pairs.select("pair_id", "question", "answer", "truncated")
    if model is None:
        rows = cut(rows)  # read four times
        model = fit_all(rows)
    return rows.mapInPandas(_label(model), SCHEMA)
