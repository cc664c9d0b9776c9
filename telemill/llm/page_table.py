"""The labelled table of text blocks: pages put together by a seeded rule from sentences, phrases and layouts.

A page is a list of (label, markup): 1 for a block of the main text, 0 for one of the page's furniture, None for
markup without text. Names of classes are left out, changed or misleading as often as on real pages, so that no single
feature tells the label.
"""

from __future__ import annotations

import random

# What pages say. Prose in several registers and languages, then short wording of furniture.
SENTENCES = (
    "The river rose again in the night, and by morning the lower road was gone.",
    "Nobody had expected the vote to be so close.",
    "It rained.",
    "In 1987 the company moved its works from the harbour to a site eleven miles inland, where land was cheap and the railway ran past the gate.",
    "“We never saw it coming,” said the keeper of the lighthouse, who has lived on the island for thirty years.",
    "Mix the flour with the butter, add the eggs one at a time, and let the dough rest for an hour.",
    "The method is simple: measure twice, cut once, and write down what you did.",
    "Her second novel sold fewer copies than the first, yet critics liked it better.",
    "Why did the bridge fail?",
    "Results for the third quarter were in line with what analysts had forecast, though costs for energy and transport grew faster than sales did.",
    "Wir haben den Versuch dreimal wiederholt und jedes Mal das gleiche Ergebnis erhalten.",
    "Der Zug fuhr pünktlich ab.",
    "La ville a grandi trop vite pour que les rues suivent, et les habitants s’en plaignent depuis des années.",
    "Il faut attendre.",
    "El puerto estuvo cerrado durante dos semanas por el temporal.",
    "To install it, unpack the archive and run the script from a shell; no further set-up is needed.",
    "She had learned to read from the labels of jars, then from the almanac, and last from a book of sermons that had lost its cover.",
    "Most of the samples came from the north slope, which is steeper and gets less sun than the south one.",
    "Two men were hurt.",
    "A good test says what went wrong, where it went wrong and with which input, so that the reader need not guess.",
)
BRIEF = ("Short.", "It rained.", "Why?", "Not so much.", "And then", "Es regnet.", "One line.", "That is all there is.")
LABELS = ("Home", "News", "About us", "Contact", "Sport", "Archive", "Log in", "Prices", "Help", "Start", "Blog", "Shop", "Kontakt", "Accueil", "Jobs", "Events")
TITLES = ("What happened at the harbour", "A short history of glass", "Ten ways to cook leeks", "Der lange Winter", "The bridge that failed", "Notes on a small engine", "How the vote was won", "Une ville trop grande")
NOTICES = ("We use cookies to make this site work for you.", "This site uses cookies and similar means; by going on you agree to this.", "Please switch on scripts to see this page.", "You have two free articles left this month.", "Your browser is old. Some things may not work.")
LEGAL = ("All rights reserved 2020 by the publisher of this site", "© 2019 The Example Company", "Copyright 2021 Example Media. All rights reserved.", "Terms of use Privacy Imprint", "Made with care in Leeds", "© example.com · Some words of the house.")
ADVERTS = ("Buy two, get one free, this week only at our shop.", "Advertisement", "The best pans for the best price", "Try it for thirty days. No card needed.", "Sponsored: a holiday by the sea for less.", "Der neue Wagen ist da.")
REMARKS = ("First!", "Great piece, thank you.", "I don't think that is right, my father worked there and he told it quite otherwise.", "Does anybody know where to buy one?", "Agreed.", "Same here in the south, it has been like that for years and nobody at the council cares about it.")
ASIDES = ("Popular now", "Most read this week", "Follow us", "Latest entries", "On this page", "Weather today", "Newsletter", "The author writes about the sea and lives by it.")


class Page:
    """Builds one page."""

    def __init__(self, rnd: random.Random):
        self.rnd, self.parts = rnd, []

    def add(self, label: int | None, markup: str) -> None:
        self.parts.append((label, markup))

    def maybe(self, share: float) -> bool:
        return self.rnd.random() < share

    def some(self, bank: tuple[str, ...], low: int, high: int) -> list[str]:
        return [self.rnd.choice(bank) for _ in range(self.rnd.randint(low, high))]

    def short(self, bank: tuple[str, ...]) -> str:
        """Wording of the bank, or as often any few words in its place; with or without an end mark."""
        rnd = self.rnd
        text = rnd.choice(bank)
        if self.maybe(0.5):
            words = " ".join(self.some(SENTENCES, 2, 2)).split()
            at = rnd.randrange(len(words))
            text = " ".join(words[at : at + max(1, round(len(text.split()) * rnd.uniform(0.5, 2)))])
        return text.rstrip(".,;:!?") + rnd.choice(["", "", ".", "!", "?", ","]) if self.maybe(0.5) else text

    def named(self, *names: str, share: float = 0.7) -> str:
        """The opening tag of a division that may bear a telling name."""
        name = self.rnd.choice(names)
        kind = self.rnd.choice(["class", "class", "id"])
        return f"<{self.rnd.choice(['div', 'div', 'section'])} {kind}='{name}'>" if self.maybe(share) else "<div>"

    def close(self, opened: str) -> None:
        self.add(None, f"</{opened[1:].split()[0].rstrip('>')}>")

    def links(self, low: int, high: int, bank: tuple[str, ...] = LABELS, listed: bool = True) -> None:
        own = [f"<a href='/{i}'>{x}</a>" for i, x in enumerate(self.short(bank) for _ in range(self.rnd.randint(low, high)))]
        if listed:
            self.add(None, "<ul>")
            for x in own:
                self.add(0, f"<li>{x}</li>")
            self.add(None, "</ul>")
        else:
            self.add(0, f"<div>{self.rnd.choice([' ', ' | ', ' · ']).join(own)}</div>")

    def paragraph(self, label: int, low: int = 1, high: int = 7) -> None:
        words = " ".join(self.some(SENTENCES, low, high)).split()
        if self.maybe(0.25):
            at = self.rnd.randrange(len(words))
            words[at] = f"<a href='/x'>{words[at]}"
            words[min(len(words) - 1, at + self.rnd.randint(0, 5))] += "</a>"
        self.add(label, f"<p>{' '.join(words)}</p>")

    def top(self) -> None:
        if self.maybe(0.5):
            opened = self.rnd.choice(["<header>", self.named("site-header", "header", "masthead", "top")])
            self.add(None, opened)
            if opened == "<header>" and self.maybe(0.4):
                self.paragraph(0, 1, 5)
            self.add(0, f"<{(t := self.rnd.choice(['div', 'h1', 'p']))}>{self.short(('The Daily Example', 'Example', 'A journal of small things'))}</{t}>")
            self.close(opened)
        if self.maybe(0.8):
            opened = self.rnd.choice(["<nav>", "<nav>", self.named("menu", "main-menu", "nav", "navigation")])
            self.add(None, opened)
            self.links(2, 7, listed=self.maybe(0.7))
            self.close(opened)
        if self.maybe(0.35):
            opened = self.named("cookie-notice", "notice", "cookies", "banner", "consent")
            self.add(None, opened)
            self.add(0, f"<p>{self.short(NOTICES)} <a href='/c'>{self.rnd.choice(['Agree', 'More', 'Accept all'])}</a></p>" if self.maybe(0.6) else f"<p>{self.short(NOTICES)}</p>")
            self.close(opened)
        if self.maybe(0.35):
            self.advert()

    def advert(self) -> None:
        opened = self.named("ad", "advert", "sponsored", "promo", share=0.9)
        self.add(None, opened)
        if opened != "<div>" and opened != "<section>" and self.maybe(0.3):
            self.paragraph(0, 1, 6)
        self.add(0, f"<p>{' '.join(self.short(ADVERTS) for _ in range(self.rnd.randint(1, 2)))}</p>" if self.maybe(0.6) else f"<a href='/ad'>{self.short(ADVERTS)}</a>")
        self.close(opened)

    def body(self) -> None:
        rnd = self.rnd
        outer = rnd.choice(["", "", "", "<div class='content-sidebar-wrap'>", "<div class='page-with-sidebar'>", "<div class='layout header-large'>"])
        opened = rnd.choice(["<article>", "<article>", "<main>", "<div role='main'>", "<div class='content'>", "<div id='story'>", "<div>", "<div>", ""])
        self.add(None, outer + opened)
        if self.maybe(0.8):
            inner = opened == "<article>" and self.maybe(0.3)
            self.add(1, f"{'<header>' * inner}<h1>{self.short(TITLES)}</h1>{'</header>' * inner}")
        if self.maybe(0.15):
            self.add(1, f"<p>{self.short(BRIEF) if self.maybe(0.7) else rnd.choice(SENTENCES)}</p>")
        else:
            for _ in range(rnd.choice([0, 1, 1, 2, 3, 4, 6, 9, 14])):
                self.passage()
        if opened:
            self.close(opened)
        if outer:
            if self.maybe(0.7):
                self.side(share=1.0)
            self.add(None, "</div>")

    def passage(self) -> None:
        rnd = self.rnd
        kind = rnd.random()
        if kind < 0.58:
            self.paragraph(1)
        elif kind < 0.66:
            self.add(1, f"<p>{self.short(BRIEF)}</p>")
        elif kind < 0.72:
            self.add(1, f"<h2>{self.short(TITLES)}</h2>")
            self.paragraph(1)
        elif kind < 0.76:
            self.add(None, "<ul>")
            for x in self.some(SENTENCES, 2, 5):
                self.add(1, f"<li>{x.rstrip('.') if self.maybe(0.5) else x}</li>")
            self.add(None, "</ul>")
        elif kind < 0.79:
            self.add(1, f"<blockquote>{rnd.choice(SENTENCES)}</blockquote>")
        elif kind < 0.81:
            self.add(1, f"<pre>{' '.join(self.some(('x = 1', 'run(y)', 'for i in z', 'return a'), 2, 8))}</pre>")
        elif kind < 0.90:  # names that look like furniture
            opened = f"<{rnd.choice(['div class', 'section id'])}='{rnd.choice(['search-history', 'related-work', 'share-of-voice', 'header-files', 'widget-design', 'social-history', 'form-and-function'])}'>"
            self.add(None, opened)
            if self.maybe(0.6):
                self.add(1, f"<h2>{self.short(TITLES)}</h2>")
            for _ in range(rnd.randint(1, 3)):
                self.paragraph(1, 3, 7)
            self.close(opened)
        elif kind < 0.95:
            opened = f"<div class='{rnd.choice(['share-buttons', 'social-share', 'newsletter-box', 'post-tags', 'related-posts', 'ad-slot'])}'>"
            self.add(None, opened)
            self.add(0, self.short(("Share", "Share this", "Tags: sea, harbour", "Read also", "Get our letter")))
            if self.maybe(0.5):
                self.links(1, 3, TITLES)
            self.close(opened)
        elif self.maybe(0.5):
            opened = rnd.choice(["<aside>", "<form>", "<nav>", "<div role='complementary'>"])
            self.add(None, opened)
            if opened == "<nav>":
                self.links(2, 5, TITLES)
            else:
                self.add(0, f"<p>{self.short(ASIDES)}</p>")
            if self.maybe(0.4):
                self.paragraph(0, 1, 5)
            self.close(opened)
        else:
            self.advert()

    def side(self, share: float = 0.7) -> None:
        opened = self.rnd.choice(["<aside>", self.named("sidebar", "widget", "related", "sidebar-left", "related-posts", share=share)])
        self.add(None, opened)
        for _ in range(self.rnd.randint(1, 3)):
            self.add(0, f"<h3>{self.short(ASIDES)}</h3>" if self.maybe(0.5) else f"<p>{self.short(ASIDES)}</p>")
            if self.maybe(0.6):
                self.links(2, 5, TITLES)
            if opened != "<div>" and self.maybe(0.25 + 0.35 * (opened == "<aside>")):
                self.paragraph(0, 1, 6)
        self.close(opened)

    def bottom(self) -> None:
        rnd = self.rnd
        if self.maybe(0.3):
            self.links(2, 4, ("Share", "Print", "Mail", "Post", "Next page", "Read more"), listed=self.maybe(0.4))
        if self.maybe(0.4):
            opened = self.named("comments", "comments-area", "comment-list", "disqus", share=0.8)
            self.add(None, opened)
            if self.maybe(0.4):
                self.add(0, f"<h3>{rnd.randint(1, 40)} comments</h3>")
            for _ in range(rnd.randint(1, 6)):
                self.add(0, f"<p>{' '.join(self.short(REMARKS) for _ in range(rnd.randint(1, 3)))}</p>")
                if opened != "<div>" and self.maybe(0.2):
                    self.paragraph(0, 1, 4)
            self.close(opened)
        if self.maybe(0.3):
            self.side()
        if self.maybe(0.35):
            if self.maybe(0.5):
                self.add(None, "<form>")
                self.paragraph(0, 1, 5)
                self.add(None, "</form>")
            self.add(0, f"<form><p>{rnd.choice(['Your name and mail address please', 'Write to us and we shall answer within two days.', 'Search this site'])}</p></form>")
        if self.maybe(0.85):
            opened = rnd.choice(["<footer>", self.named("footer", "site-footer", "bottom", "copyright", share=0.6)])
            self.add(None, opened)
            self.add(0, f"<p>{self.short(LEGAL)}</p>" if self.maybe(0.6) else self.short(LEGAL))
            if self.maybe(0.3):
                self.links(2, 4, ("Terms", "Privacy", "Imprint", "Cookies"), listed=self.maybe(0.5))
            if opened == "<footer>" and self.maybe(0.5):
                for _ in range(rnd.randint(1, 3)):
                    self.paragraph(0, 1, 6)
            self.close(opened)


def page(rnd: random.Random) -> list[tuple[int | None, str]]:
    """A page with labels."""
    built = Page(rnd)
    bare = built.maybe(0.08)  # nothing but the text
    if not bare:
        built.top()
    built.body()
    if not bare and built.maybe(0.6):  # others end with their text
        built.bottom()
    return built.parts


def pages(seed: int, n: int) -> list[list[tuple[int | None, str]]]:
    """``n`` pages; equal seeds give equal ones."""
    rnd = random.Random(seed)
    return [page(rnd) for _ in range(n)]
