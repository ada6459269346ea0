"""Votes of stop words for a language."""

from __future__ import annotations

import re

# Frequent function words of each language, those of two languages left out where they decide little.
STOPWORDS = {
    "en": "the a an of and to in is was were are be been has had have with that this these those it its for on by from as at or not but than they we you he she which who what how when where why there their our your would could should can may will did does do more most some every both one only no before after about into over between during under if while",
    "de": "der die das den dem des ein eine einen einem einer eines und oder nicht ist war wird wurde wurden werden sind hat haben hatte hatten mit von vom zum zur bei für auf aus nach über unter durch ohne gegen um dass wenn weil als wie wer was welche welcher welches warum wieso weshalb auch noch nur sich sie er es ihr wir man im ins am an zu doch sondern erst schon sehr mehr viele alle keine kein seit zwischen während vor allem neben wieder nach niemand denen dessen deren hält nennt so dieser diese dieses geschah spielt dauerte lange bis",
    "fr": "le la les un une des du de et ou ne pas est était été sont ont avait avec pour par sur dans sans sous chez vers entre que qui quoi dont où quel quelle quels quelles pourquoi comment combien il elle ils elles on nous vous je ce cet cette ces son sa ses leur leurs au aux en plus moins très bien aussi mais comme si se sera serait depuis avant après pendant selon a à l d qu c n j s lui même ne jamais où été ceux celui d'un ni faut quand",
    "es": "el la los las un una unos unas del de y o no es era fue fueron son ha han había con para por sobre en sin bajo desde hasta entre que quien quién qué cuál cuánto cuándo cómo dónde porque se su sus le les lo al más menos muy también pero como si este esta estos estas ese esa hay ser sido sería según antes después durante en a hace hacen otro otra otros otras cada nada todo mismo misma día cuya nunca quien quienes donde",
}

_votes: dict[str, tuple[str, ...]] = {}
for _language, _words in STOPWORDS.items():
    for _word in _words.split():
        _votes[_word] = (*_votes.get(_word, ()), _language)

_WORD = re.compile(r"[^\W\d_]+")


def votes(text: str) -> dict[str, float]:
    """Points by language: 1 for each stop word, shared out among the languages that have it."""
    found: dict[str, float] = {}
    for word in _WORD.findall(text.lower()):
        for language in (own := _votes.get(word, ())):
            found[language] = found.get(language, 0) + 1 / len(own)
    return found


def language(text: str, least: float = 1.5, lead: float = 1.8) -> str | None:
    """The language with at least ``least`` points and ``lead`` times those of any other; else None."""
    found = sorted(votes(text).items(), key=lambda x: -x[1])
    if not found or found[0][1] < least or (len(found) > 1 and found[0][1] < lead * found[1][1]):
        return None
    return found[0][0]


def only(text: str, one: str, other: str) -> tuple[int, int]:
    """Stop words of ``one`` that ``other`` lacks, and the reverse."""
    a = b = 0
    for word in _WORD.findall(text.lower()):
        own = _votes.get(word)
        if own:
            first, second = one in own, other in own
            a += first and not second
            b += second and not first
    return a, b
