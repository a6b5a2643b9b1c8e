"""Sample pages of known kinds: spam, lists, records, junk and prose.

They are built by rule from invented words and the given function words, so that
they show how a page is made up and say nothing about its vocabulary. A bounded
labelled sample: a fixed number of pages of every kind, the same in every run.
"""

from __future__ import annotations

from collections.abc import Callable
from random import Random

#: The kinds that are spam.
SPAM = ("stuffed", "listed", "placed", "bare", "tagged", "labelled", "anchored", "products")


class _Page:
    """What the rules draw from: random choices, and words of a page's own vocabulary."""

    def __init__(self, draw: Random, function: list[str]):
        self.draw, self.function = draw, function or ["a"]
        self.rows = draw.randint(10, 30)
        self.few, self.many = [self.word() for _ in range(40)], [self.word() for _ in range(150)]

    def word(self) -> str:
        return "".join(self.draw.choice("bdfgklmnprstvz") + self.draw.choice("aeiou") for _ in range(self.draw.randint(2, 4)))

    def number(self, low: int = 100, high: int = 4000) -> int:
        return self.draw.randint(low, high)

    def some(self, n: int, words: list[str] | None = None) -> str:
        return " ".join(self.draw.choice(words or self.few) for _ in range(n))

    def url(self) -> str:
        return f"https://www.{self.word()}.example/{self.word()}/{self.word()}-{self.word()}-{self.number()}"

    def owner(self) -> str:
        return f"{self.draw.choice(self.few[:8])}-{self.draw.choice(self.few[8:12])}"

    def sentence(self, end: str = "") -> str:
        words = [self.draw.choice(self.function) if self.draw.random() < 0.42 else self.word() for _ in range(self.draw.randint(9, 20))]
        return " ".join(words).capitalize() + (f" {end}" if end else "") + "."

    def values(self) -> list[str]:
        """What a record holds."""
        return [self.some(2, self.many), self.draw.choice(self.few[:8]), str(self.number()), self.some(1, self.few[30:]), f"REQ-{self.number(10000, 99999)}"]

    def lines(self, make: Callable[[int], object], mark: str = "\n") -> str:
        return mark.join(str(make(i)) for i in range(self.rows))

    def pool(self) -> list[str]:
        """A few key phrases."""
        return [self.some(self.draw.randint(1, 3)) for _ in range(self.draw.randint(6, 12))]


def _repeated(p: _Page, mark: str) -> str:
    pool = p.pool()
    return mark.join(p.draw.choice(pool) for _ in range(p.rows * 3))


def _placed(p: _Page, number: int) -> str:
    """A few phrases with many places, which may be numbered, and with other key words or none."""
    phrases = [p.some(3) for _ in range(1 + number % 2)]
    places = [p.word().capitalize() + (str(p.number(1, 99)) if number % 4 == 2 else "") for _ in range(15)]
    return p.lines(lambda _: f"{p.draw.choice(phrases)} {p.draw.choice(p.function)} {p.draw.choice(places)} {p.some(2 * (number % 4 != 2))}".strip(), ("; ", ", ")[number % 2])


def _anchored(p: _Page, number: int) -> str:
    made = (lambda _: f"[{p.some(3)}]({p.url()})") if number % 2 else (lambda _: f'<a href="{p.url()}">{p.some(3)}</a>')
    return p.lines(made, p.draw.choice(["\n", " ", " | "]))


def _linked(p: _Page, number: int) -> str:
    """Prose with links in it and a list of links below."""
    prose = " ".join(p.sentence(f"[[{p.some(2)}]]" if k % 2 else "") for k in range(4 + number % 6))
    return f"== {p.some(3)} ==\n\n{prose}\n\n" + "\n".join(f"* [[{p.some(2 + number % 3, p.many)}]]" for _ in range(3 + number % 5))


def _objects(p: _Page, number: int) -> str:
    gap, lines = (" ", "\n        ") if number % 2 else ("", " ")
    value = (lambda: p.values()[:4]) if number % 3 else (lambda: [p.some(2, p.many), p.owner(), p.some(1, p.few[30:]), f"REQ-{p.number(10000, 99999)}", p.owner()])
    return "[" + p.lines(lambda _: "{" + lines + f",{lines}".join(f'"{name}"{gap}:{gap}"{x}"' for name, x in zip(p.few, value())) + "}", f",{lines}") + "]"


def _series(p: _Page) -> str:
    name = p.some(2)
    return p.lines(lambda _: f"{name} {p.number(0, 99):02} ({p.owner()}) {p.draw.choice(p.few[:6])}, {p.number(2, 90)} {p.draw.choice(p.few[20:26])}")


def _noise(p: _Page) -> str:
    """What is left of an unreadable scan."""
    return " ".join("".join(p.draw.choice("..:,-|0O1lIimrnpqa2k") for _ in range(p.draw.randint(1, 4))) for _ in range(p.rows * 5))


def _letters(p: _Page, signs: str, least: int, most: int) -> str:
    return " ".join("".join(p.draw.choice(signs) for _ in range(p.draw.randint(least, most))) for _ in range(p.rows * 5))


# each rule makes a page from its vocabulary and its number within the kind
_RULES: dict[str, Callable[[_Page, int], str]] = {
    "stuffed": lambda p, i: _repeated(p, " "),
    "listed": lambda p, i: _repeated(p, (", ", "; ", " | ", "\n")[i % 4]),
    "placed": _placed,
    "bare": lambda p, i: p.lines(lambda _: p.url()),
    "tagged": lambda p, i: p.lines(lambda _: f"#{p.some(1)} #{p.some(1)}", " "),
    "labelled": lambda p, i: p.lines(lambda k: f"{('* ', '', f'{k + 1}. ')[k % 3]}{p.some(3)}{p.draw.choice([': ', ' => ', ' '])}{p.url()}"),
    "anchored": _anchored,
    "products": lambda p, i: p.lines(lambda _: f"SKU {p.number(10000, 99999)} {p.some(3)} ${p.number(1, 99)}.{p.number(10, 99)} tags: {', '.join(p.some(1, p.few[:20]) for _ in range(p.number(3, 7)))}"),
    "prose": lambda p, i: p.lines(lambda _: p.sentence(), " "),
    "refrain": lambda p, i: (lambda again: p.lines(lambda k: again if k % 3 == 0 else p.sentence(), " "))(p.sentence()),
    "reference": lambda p, i: p.lines(lambda k: p.sentence(p.url() if k % 3 == 0 else ""), " "),
    "linked": _linked,
    "items": lambda p, i: p.lines(lambda _: f"{'-•–'[i % 3]} {p.some(2 + i % 2, (p.many, p.few[:25], p.few[:15])[i % 4 % 3])}"),
    "pairs": lambda p, i: p.lines(lambda _: f"{'-•–'[i % 3]} {p.some(1, p.few[:20])} {p.some(1, p.few[20:])}"),
    "register": lambda p, i: p.lines(lambda _: f"{p.some(1)} {p.some(1, p.many)}: {p.some(2, p.many)}, {p.some(2, p.many)}"),
    "contents": lambda p, i: p.lines(lambda k: f"{k + 1}.{p.number(1, 9)} {p.some(2, p.many)} {p.draw.choice(['....... ', ''])}{p.number(1, 300)}"),
    "table": lambda p, i: ",".join(p.few[:5]) + "\n" + p.lines(lambda _: (",", ", ")[i % 2].join([p.some(2, p.many), p.owner(), str(p.number()), f"2025-{p.number(10, 12)}-{p.number(10, 28)}", f"REQ-{p.number(10000, 99999)}"])),
    "fields": lambda p, i: p.lines(lambda _: (" | ", "; ")[i % 2].join(map(": ".join, zip(p.few, p.values())))),
    "blocks": lambda p, i: p.lines(lambda _: "\n".join(map(": ".join, zip(p.few, p.values()[:4]))), "\n\n"),
    "objects": _objects,
    "notes": lambda p, i: p.lines(lambda _: f"{p.some(1, p.few[:3])} {p.number(10000, 99999)} {p.some(3, p.many)} ({p.owner()})", ("\n", " ")[i % 2]),
    "series": lambda p, i: _series(p),
    "noise": lambda p, i: _noise(p),
    "rules": lambda p, i: p.lines(lambda k: f"{p.draw.choice('.:-+') * p.number(5, 40)} {p.number(80, 9999)} {p.word()[:2]} {p.draw.choice('.:-+') * p.number(5, 40)}"),
    "garble": lambda p, i: _letters(p, ("Ã¤âÅ“Â»gñxqtjk€™", "Ã¤â€œÅ“Â»Ã±Â°Ã¨ï»¿gxqbn", "Ãâ“™€Å“»°¿�Ã¨Â»…gx")[i % 3], 2, 9),
    "gibberish": lambda p, i: _letters(p, "asdfghjklqwertuiop", 2, 10),
    "loose": lambda p, i: p.lines(lambda _: p.some(5, p.many), " "),
    "dump": lambda p, i: p.lines(lambda k: f"{k * 16:08x}  " + " ".join(f"{p.number(0, 255):02x}" for _ in range(16))),
}


def sample_pages(function: list[str], each: int) -> dict[str, list[str]]:
    """``each`` pages of every kind; ``function`` are the function words of their sentences."""
    return {kind: [rule(_Page(Random(f"{kind} {i}"), function), i) for i in range(each)] for kind, rule in _RULES.items()}
