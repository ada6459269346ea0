"""Problem 4: unsound answers and the kind of their defect.

Method: the response traverses a suffix automaton of the prompt's words, which measures how much of it is copied;
an Aho–Corasick automaton finds refusals; a stack of delimiters finds what was left open; stop words vote for languages.

Null and blank responses, placeholders and bare labels are ``empty``, which stands alone; a null prompt has no words
and no language. Repeated rows and rows with null ids are judged like any other.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.base import map_chunks
from sparkloom.llm.languages import language, only, votes

EMPTY, TRUNCATED, REFUSAL, COPIES, OTHER = "empty", "truncated", "refusal", "copies_question", "other_language"

# What stands for no answer, lower case, without brackets and marks.
PLACEHOLDERS = set("|na|n a|null|none given|nan|nil|todo|tbd|tba|empty|no answer|no response|no content|blank|undefined|missing|placeholder|nbsp|a|answer|response|output|assistant|antwort|réponse|respuesta|keine antwort|pas de réponse|sin respuesta|p p|br|div div|lorem ipsum".split("|"))
# How an assistant declines, in lower case, words parted by single spaces, apostrophes as '.
REFUSALS = """
i cannot answer|i can't answer|i cannot help|i can't help|i cannot assist|i can't assist|i cannot provide|i can't provide|i cannot discuss|i can't discuss|i cannot respond|i can't respond|i cannot comment|i can't comment|i cannot fulfil|i can't fulfil|i cannot comply|i can't comply|i cannot do that|i can't do that|i cannot share|i can't share
i am unable to|i'm unable to|i am not able to|i'm not able to|i won't be able to|i will not be able to|i am not allowed to|i'm not allowed to|i am not permitted to|i'm not permitted to|i must decline|i have to decline|i decline to|i must refuse|i'd rather not|i would rather not
i am not comfortable|i'm not comfortable|i do not have access to|i don't have access to|i do not have enough information|i don't have enough information|not something i can|outside what i|outside of what i|beyond what i can|can't be fulfilled|cannot be fulfilled|not be appropriate for me|not appropriate for me|no answer can be given by|guidelines do not allow|guidelines don't allow|as a language model|as an ai|i apologize, but|i apologize, however|i apologise, but|i'm sorry, but|i am sorry, but|against my guidelines
kann ich nicht beantworten|kann ich nicht helfen|nicht helfen|darf ich leider nicht|darf ich nicht|kann ich leider nicht|kann ich dazu nichts|ich kann ihnen nicht|ich kann dir nicht|ich kann dazu nichts|ich kann diese frage|es tut mir leid|tut mir leid|leider nicht beantworten|als sprachmodell|bin ich nicht befugt|nicht in der lage
je ne peux pas|je ne suis pas en mesure|ne m'est pas possible|m'est impossible|en tant que modèle|désolé, je|désolée, je|je suis désolé|je dois refuser|je regrette, mais|je ne dispose pas
no puedo responder|no puedo ayudar|no puedo contestar|no puedo atender|no puedo proporcionar|no me es posible|lo siento, pero|lo siento, no|como modelo de lenguaje|no estoy autorizado|debo rechazar|no tengo acceso|no tengo permitido
"""
# What may stand beside a refusal.
COURTESIES = "thank you|thanks|hello|is there another|anything else|something else|another topic|ask me|let me know|i hope|have a nice|regards|best wishes|gerne|danke|guten tag|merci|bonjour|gracias|hola|please|bitte|certainly|of course|good question|great question|sure|unfortunately|leider"
# What introduces a repeated question.
LEADS = re.compile(r"^\W*(?:you (?:asked|want to know)|the question (?:is|was)|question|prompt|q|a|answer|(?:die|ihre) frage (?:lautet|ist)|sie fragen|frage|vous (?:demandez|avez demandé)|la question (?:est|posée est)|la pregunta (?:es|dice)|usted pregunta|pregunta|preguntó)\s*[:：]\s*", re.IGNORECASE)
ASKED = {
    "en": r"english|englisch|anglais|inglés|ingles", "de": r"german|deutsch|allemand|alemán|aleman",
    "fr": r"french|französisch|franzoesisch|français|francais|francés|frances", "es": r"spanish|spanisch|espagnol|español|espanol|castellano",
}
_ASK = {k: re.compile(rf"\b(?:in|auf|ins|en|reply|answer|antworte|write|translate|al|to)\b[^.\n]{{0,25}}\b(?:{v})\b|\b(?:{v}),? (?:please|bitte)|(?:please|bitte),? (?:auf )?\b(?:{v})\b", re.IGNORECASE) for k, v in ASKED.items()}

_QUOTED = re.compile(r"“[^”]*”|„[^“”]*[“”]|«[^»]*»|\"[^\"]*\"")
_CODE = re.compile(r"```.*?(?:```|\Z)", re.DOTALL)
_ROLE = re.compile(r"^\s*\[(system|user|assistant)\]\s*", re.IGNORECASE | re.MULTILINE)
_WORDS = re.compile(r"[^\W_]+")
_ENTRY = re.compile(r"\s*(?:[-*•‣◦–]|\(?\d{1,3}[.)])\s+\S")
_MARKER = re.compile(r"\s*(?:[-*•‣◦–]|\(?\d{1,3}[.)])\s*$")
_CLOSED = re.compile(r"(?:[.!?。！？]|[.!?]?[”“’\"'»)\]`*_]+)\s*$")
_TAIL = re.compile(r"(?:[,;:–—\-(/&]|…|\.\.\.)\s*$")
_ARTICLE = re.compile(r"(?:l'|l’|le |la |les |el |los |las |der |die |das |un |una |une |ein |eine )", re.IGNORECASE)
_NAMES = re.compile(r"[A-ZÀ-Þ][\w'-]+ (?:and|und|et|y|e|or|oder|ou|o) [A-ZÀ-Þ][\w'-]+$")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"”’)]*\s+")
# A phrase with one of these is a sentence begun, not a name.
_VERBS = set("is was were are has had have been est était ont sont avait a été fue fueron era son ha han había habría wurde war ist sind hat wird n'a ne no nicht darf".split())
_OPEN = {"(": ")", "[": "]", "{": "}", "“": "”", "„": "“”", "«": "»"}


def _automaton(phrases: Iterable[str]) -> ahocorasick.Automaton:
    built = ahocorasick.Automaton()
    for phrase in phrases:
        if phrase:
            built.add_word(phrase, phrase)
    built.make_automaton()
    return built


_refusals = _automaton(p for line in REFUSALS.strip().split("\n") for p in line.split("|"))
_courtesies = _automaton(COURTESIES.split("|"))


class SuffixAutomaton:
    """All runs of a sequence of words."""

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for word in words:
            state = self._state(self.length[last] + 1, {}, 0)
            at = last
            while at >= 0 and word not in self.next[at]:
                self.next[at][word] = state
                at = self.link[at]
            if at >= 0:
                to = self.next[at][word]
                if self.length[to] != self.length[at] + 1:
                    twin = self._state(self.length[at] + 1, dict(self.next[to]), self.link[to])
                    while at >= 0 and self.next[at].get(word) == to:
                        self.next[at][word] = twin
                        at = self.link[at]
                    self.link[to] = twin
                    to = twin
                self.link[state] = to
            last = state

    def _state(self, length: int, following: dict[str, int], link: int) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def covered(self, words: list[str], least: int) -> int:
        """How many of ``words`` lie in runs of at least ``least`` words of the sequence.

        >>> SuffixAutomaton("why did it rain".split()).covered("because it rain why did".split(), 2)
        4
        """
        state = length = total = reach = 0
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            if length >= least:
                total += i + 1 - max(reach, i + 1 - length)
                reach = i + 1
        return total


def plain(text: str) -> str:
    """Invisible characters, tags and entities removed."""
    return re.sub(r"[​-‏⁠﻿­]|<[^<>]*>|&nbsp;", "", text)


def is_empty(text: str | None) -> bool:
    """Nothing that says anything: blank, only marks, a placeholder or a label."""
    if text is None:
        return True
    said = plain(text)
    bare = " ".join(_WORDS.findall(said.lower()))
    return not bare or bare in PLACEHOLDERS and len(" ".join(said.split())) <= 40


def question_of(prompt: str) -> str:
    """What is asked: the last user message where there are role marks, else the whole."""
    parts = _ROLE.split(prompt)
    if len(parts) == 1:
        return prompt
    told = [b for a, b in zip(parts[1::2], parts[2::2]) if a.lower() == "user"]
    return told[-1] if told else parts[0]


def unclosed(text: str) -> bool:
    """Whether a bracket, quote or code fence is open at the end. Closing marks without an opening one don't matter."""
    if text.count("```") % 2:
        return True
    stack: list[str] = []
    for char in _CODE.sub("", text):
        if char in _OPEN:
            if not (stack and char in stack[-1]):
                stack.append(_OPEN[char])
            else:
                stack.pop()
        elif stack and char in stack[-1]:
            stack.pop()
    return bool(stack)


def is_truncated(text: str) -> bool:
    """Whether the text stops within a sentence, list entry or code block."""
    text = plain(text).rstrip()
    if unclosed(text):
        return True
    if text.endswith("```"):
        return False
    line = text.rsplit("\n", 1)[-1]
    if _MARKER.match(line) and ("\n" in text or len(line) < len(text)):
        return True
    if _TAIL.search(line):
        return True
    words = _WORDS.findall(line.lower())
    last = words[-1] if words else ""
    dangling = last in _DANGLING
    if _ENTRY.match(line):
        return dangling
    if _CLOSED.search(line):
        return False
    if dangling or "\n" in text or _SENTENCE.search(text):
        return True
    tokens = text.split()  # one phrase without a full stop: an answer in a few words or a sentence begun
    if len(tokens) <= 2 or _NAMES.match(text):
        return False
    numbers = sum(t[0].isdigit() for t in tokens)
    if len(tokens) <= 4 and numbers == 1:
        return False
    return not (len(tokens) <= 6 and _ARTICLE.match(text) and not _VERBS & set(words))


# No sentence or entry ends with these.
_DANGLING = set("the a an of and or to with for by in on at from into than that which whose because but if as is was were are be been not only der die das den dem ein eine einen einem und oder mit von für zu im am dass weil wenn ob als wie durch über le la les un une des du de et ou pour par avec dans sur que qui dont parce est sont au aux el los las una unos y o del para por con en se porque fue es".split())


def is_refusal(text: str) -> bool:
    """Whether the text declines and says nothing else."""
    low = _QUOTED.sub(" ", plain(text)).lower().replace("’", "'")
    low = " ".join(low.split())
    if next(_refusals.iter(low), None) is None:
        return False
    rest = 0
    for sentence in _SENTENCE.split(low):
        words = len(sentence.split())
        if words > 2 and next(_refusals.iter(sentence), None) is None and next(_courtesies.iter(sentence), None) is None:
            rest += words
    return rest <= 3


def is_copy(question: str, response: str) -> bool:
    """Whether the response says nothing beyond the question, however often it repeats it, a word or two aside."""
    said = _WORDS.findall(LEADS.sub("", plain(response)).lower())
    if len(said) < 4:
        return False
    asked = _WORDS.findall(LEADS.sub("", question).lower())
    if not asked:
        return False
    spare = max(2, min(len(said), 3 * len(asked) + 4) // 6)  # more repetitions don't allow for more words of its own
    there = set(asked)
    if sum(w in there for w in said) < len(said) - spare:
        return False
    automaton = SuffixAutomaton(asked)
    extra = len(said) - automaton.covered(said, 2)
    back = SuffixAutomaton(said).covered(asked, 2)  # a short answer in the question's words is no copy of it
    return extra <= spare and back >= 0.6 * len(asked)


def is_foreign(prompt: str, question: str, response: str) -> bool:
    """Whether the response is in another language than the question, which nobody asked for."""
    words = _QUOTED.sub(" ", _CODE.sub(" ", plain(response)))
    found = votes(words)
    if not found:
        return False
    spoken = max(found, key=lambda x: found[x])
    asked = language(_QUOTED.sub(" ", question), least=1.0, lead=1.3)
    if asked is None or asked == spoken or _ASK[spoken].search(prompt):
        return False
    theirs, ours = only(words, spoken, asked)  # words that both languages have decide nothing
    return theirs >= 2 and theirs >= 3 * ours


def defects(prompt: str | None, response: str | None) -> list[str]:
    """Kinds of the defects of a pair.

    >>> defects("Why?", " n/a "), defects("Who was it?", "It was the old"), defects("Who won the cup?", "Ada.")
    (['empty'], ['truncated'], [])
    """
    if is_empty(response):
        return [EMPTY]
    assert response is not None
    prompt = prompt or ""
    question = question_of(prompt)
    found = []
    if is_truncated(response):
        found.append(TRUNCATED)
    if is_refusal(response):
        found.append(REFUSAL)
    if is_copy(question, response):
        found.append(COPIES)
    if is_foreign(prompt, question, response):
        found.append(OTHER)
    return found


def _judge(data: dict) -> dict:
    out: dict[str, list] = {"origin": [], "pair_id": [], "defect": []}
    for origin, pair, prompt, response in zip(data["origin"], data["pair_id"], data["prompt"], data["response"]):
        for defect in defects(prompt, response):
            for name, value in zip(out, (origin, pair, defect)):
                out[name].append(value)
    return out


def unsound(pairs: DataFrame) -> DataFrame:
    """origin, pair_id, defect from origin, pair_id, prompt, response; one row for each defect."""
    rows = pairs.select("origin", "pair_id", "prompt", "response", F.concat_ws(" ", "prompt", "response").alias("both"))
    return map_chunks(rows, "both", "origin string, pair_id long, defect string", _judge)


def answer_pairs(results: DataFrame, prompts: DataFrame) -> DataFrame:
    """Both tables in the form that ``unsound`` takes."""
    a = results.select(F.lit("sample_results").alias("origin"), F.col("result_id").alias("pair_id"), F.col("question").alias("prompt"), F.col("reference_answer").alias("response"))
    return a.unionByName(prompts.select(F.lit("prompts").alias("origin"), F.col("entry_id").alias("pair_id"), "prompt", "response"))
