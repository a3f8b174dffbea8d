"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page becomes a sequence of leaf blocks: texts between boundaries of block elements, each with the tags and class words of
its ancestors. Two labels, main text or not; emission features are read from ancestors and text, transitions join neighbours.
The field is trained by penalised maximum likelihood on labelled pages: those whose blocks were labelled by hand (labelled_pages.py),
and a bounded sample of corpus pages whose own markup leaves no doubt what their parts are. Decoding is by Viterbi.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache
from html.parser import HTMLParser
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, read
from .labelled_pages import PAGES

#: Pages of the corpus to learn from, at most: the first in order of a hash of their id and html.
LEARN_PAGES = 400
#: How often each page labelled by hand is shown, each time with other features hidden.
SHOWN = 6
#: Feature weights: features are hashed to this many.
FEATURES = 1 << 14
STEPS, RATE, RIDGE = 150, 0.15, 1e-3
#: Share of the ancestor features hidden at random in training, so that no single tag decides alone.
HIDDEN = 0.25
#: Share of the showings in which a page's elements have no names at all.
NAMELESS = 0.4
#: Letters of a class word that are a feature of their own (responses, response and respond share them), and the most words of a text that speaks
#: by its words (a label, a button, a heading).
BEGINNING, FEW_WORDS = 4, 6

#: HTML elements by role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
UNSEEN = set("script style noscript template svg math iframe object".split())
CLOSES_P = set("address article aside blockquote details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul li dd dt tr td th".split())
CLOSED_BY_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that say what they hold, for labels of corpus pages.
MAIN_TAGS, OTHER_TAGS = {"article", "main"}, {"nav", "header", "footer", "aside", "form", "head", "button", "select", "menu", "dialog"}
CLASS_WORD = re.compile(r"[a-z]+")
WORD = re.compile(r"\w+")


#: Words of a writer who speaks for themselves, to somebody, or in thanks and agreement, in the languages of the corpus.
FIRST_PERSON = set("i i'm i've i'd me my mine myself ich mir mich mein meine meinen meiner je j'ai moi mon ma mes yo mí mi mis".split())
SECOND_PERSON = set("you your yours du dir dich dein deine ihr euch euer vous votre vos tu te toi ton ta usted ustedes vosotros vuestro tú".split())
REPLYING = set("thanks thank agree disagree anyone anybody lol yes hello hi sorry imho danke dank stimmt hallo merci accord bonjour gracias acuerdo hola".split())
#: What parts spoken words; an apostrophe doesn't.
PARTING = str.maketrans({c: " " for c in ".,;:!?()[]\"«»„“”‚‘…–—/"} | {"’": "'"})
#: Elements that hold one paragraph, item or heading: what contains them is a block's box.
LEAVES = HEADINGS | set("p li blockquote pre dt dd td th tr figcaption label button option summary".split())


class Blocks(HTMLParser):
    """Leaf blocks of a page, in page order: (text, ancestor tags, ancestor class and id words, share of linked characters, ancestor numbers)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, frozenset[str], int]] = []
        self.blocks: list[tuple[str, tuple[str, ...], frozenset[str], float, tuple[int, ...]]] = []
        self.opened = 0
        self.parts: list[str] = []
        self.linked, self.unseen = 0, 0

    def cut(self) -> None:
        """A block boundary."""
        text = " ".join("".join(self.parts).split())
        if text:
            words = frozenset().union(*(w for _, w, _ in self.stack)) if self.stack else frozenset()
            above = [(t, number) for t, _, number in self.stack if t not in INLINE]
            self.blocks.append((text, tuple(t for t, _ in above), words, min(1.0, self.linked / len(text)), tuple(number for _, number in above)))
        self.parts, self.linked = [], 0

    def pop_to(self, tags: set[str], stop: set[str]) -> None:
        """Close the innermost open element of these tags, and what is open within it, unless one of stop stands between."""
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] in tags:
                self.unseen -= sum(t in UNSEEN for t, _, _ in self.stack[i:])
                del self.stack[i:]
                return
            if self.stack[i][0] in stop:
                return

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.parts.append("\n")
            return
        if tag not in INLINE:
            self.cut()
            if tag in CLOSES_P:
                self.pop_to({"p"}, {"article", "section", "div", "td", "li", "blockquote"})
            if tag in CLOSED_BY_SAME:
                self.pop_to(CLOSED_BY_SAME[tag], {"ul", "ol", "dl", "table", "select"})
        if tag in VOID:
            return
        words = frozenset(w for k, v in attrs if v and k in ("class", "id", "role") for w in CLASS_WORD.findall(v.lower()))
        self.opened += 1
        self.stack.append((tag, words, self.opened))
        self.unseen += tag in UNSEEN

    def handle_startendtag(self, tag, attrs):
        if tag == "br" or tag in INLINE:
            self.parts.append("\n" if tag == "br" else "")
        else:
            self.cut()

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.cut()
        self.pop_to({tag}, {"article", "body"} if tag in INLINE else set())

    def handle_data(self, data):
        if not self.unseen:
            self.parts.append(data)
            if any(t == "a" for t, _, _ in self.stack):
                self.linked += len(data.strip())


def blocks_of(html: str) -> list[tuple[str, tuple[str, ...], frozenset[str], float, tuple[int, ...]]]:
    page = Blocks()
    page.feed(html)
    page.close()
    page.cut()
    return page.blocks


@lru_cache(1 << 17)
def hashed(name: str) -> int:
    return xxhash.xxh3_64_intdigest(name) % FEATURES


def voice_of(text: str) -> frozenset[str]:
    """Who speaks in a text: "first", "second", "reply", "asks", "exclaims"."""
    said = set(text.lower().translate(PARTING).split())
    of = {"first": said & FIRST_PERSON, "second": said & SECOND_PERSON, "reply": said & REPLYING, "asks": "?" in text, "exclaims": "!" in text}
    return frozenset(k for k, found in of.items() if found)


def surroundings(blocks: list[tuple]) -> list[list[int]]:
    """Feature numbers of what a block's place among the others says, whatever its ancestors are called.

    A block's box is the element that holds its paragraph; the page's home is the box that holds the most unlinked text. A block outside the home
    belongs to a group: the outermost element that holds it and not the home's own blocks. Features tell where the group lies to the home, whether
    blocks of the home follow, how much the group holds, of how many boxes and blocks of which voice; and whether a block of the home lies in an ending
    of speakers' and short blocks.
    """
    boxes = [next((number for t, number in zip(reversed(tags), reversed(path), strict=True) if t not in LEAVES), 0) for _, tags, _, _, path in blocks]
    mass: dict[int, float] = {}
    for box, (text, _, _, linked, _) in zip(boxes, blocks, strict=True):
        mass[box] = mass.get(box, 0) + len(text) * (1 - linked)
    home = max(mass, key=lambda b: (mass[b], -b))
    own = [i for i, b in enumerate(boxes) if b == home]
    # elements on the way from the root to the home
    trunk = set(blocks[own[0]][4][: blocks[own[0]][4].index(home) + 1]) if home else set()
    groups = [box if box in trunk else next((number for number in path if number not in trunk), 0) for box, (_, _, _, _, path) in zip(boxes, blocks, strict=True)]
    members: dict[int, list[int]] = {}
    for i, g in enumerate(groups):
        members.setdefault(g, []).append(i)
    voices = [voice_of(b[0]) for b in blocks]
    length = [len(b[0]) for b in blocks]
    usual = sorted(length[i] for i in own)[len(own) // 2]
    # the end of the home, if from some block on all speak or are short, and not all before it do
    speaks = [bool(v & {"first", "second", "reply"}) for v in voices]
    tail = len(own)
    while tail and (speaks[own[tail - 1]] or length[own[tail - 1]] < usual / 2):
        tail -= 1
    ending = set(own[tail:]) if tail else set()
    of_group = {}
    for g, some in members.items():
        long = [i for i in some if len(blocks[i][0].split()) > FEW_WORDS] or some
        share = lambda kinds: sum(bool(voices[i] & kinds) for i in long) * 2 / len(long)  # noqa: B023, E731
        weight = sum(len(blocks[i][0]) * (1 - blocks[i][3]) for i in some)
        of_group[g] = (
            f"boxes:{min(3, len({boxes[i] for i in some}))}", f"blocks:{min(4, len(some))}", f"weight:{round(4 * weight / max(1.0, mass[home]))if weight < 2 * mass[home] else 8}",
            f"mean:{min(4, round(4 * sum(length[i] for i in long) / len(long) / max(1, usual)))}", f"talk:{round(share({'first', 'second', 'reply'}))}", f"excited:{round(share({'asks', 'exclaims'}))}",
        )
    out = []
    known: dict[tuple, list[int]] = {}
    for i, (box, g, (_, _, _, _, path)) in enumerate(zip(boxes, groups, blocks, strict=True)):
        where = "home" if box == home else "around" if box in trunk else "inside" if home in path else "beside"
        when = "before" if i < own[0] else "after" if i > own[-1] else "among"
        kind = (g, where, when, i in ending, voices[i])
        if kind not in known:
            talk = next(f for f in of_group[g] if f.startswith("talk:"))
            names = [f"where:{where}", f"when:{when}", f"at:{where} {when}", *(f"group {where} {f}" for f in of_group[g]), f"group {where} {when} {talk}", *(f"voice:{v}" for v in voices[i]), *(f"voice {where}:{v}" for v in voices[i])]
            names += [f"ending:{i in ending}", f"ending:{i in ending} {speaks[i]}", *(f"ending voice:{v}" for v in voices[i] if i in ending)]
            known[kind] = [hashed(x) for x in names]
        out.append(known[kind])
    return out


def features_of(blocks: list[tuple], hide: random.Random | None = None) -> list[list[int]]:
    """Feature numbers of each block, from its ancestors, its whole text, the heading it stands under and its surroundings; with `hide` some ancestor features
    are left out, and on some pages all names."""
    out = []
    n = len(blocks)
    if not n:
        return out
    heading: set[str] = set()
    around = surroundings(blocks)
    ancestors: dict[tuple, list[int]] = {}
    nameless = hide is not None and hide.random() < NAMELESS
    for i, (text, tags, words, linked, _) in enumerate(blocks):
        words = frozenset() if nameless else words
        own = tags[-1] if tags else ""
        all_words = text.split()
        spoken = WORD.findall(text.lower()) if len(all_words) <= FEW_WORDS else ()
        few = set(spoken) if len(spoken) <= FEW_WORDS else set()
        if own in HEADINGS:
            heading = few
        elif heading and i and own not in blocks[i - 1][1] and tags[:-1] != blocks[i - 1][1][: len(tags) - 1]:
            heading = set()
        if (tags, words) not in ancestors or hide is not None:
            above = [*(f"in:{t}" for t in set(tags) - {"html", "body"}), *(f"word:{w}" for w in words), *{f"begins:{w[:BEGINNING]}" for w in words}, f"path:{'>'.join(tags[-2:])}", f"named:{min(2, len(words))}", f"parent:{own}"]
            # of a page that is read, blocks of the same ancestors share their numbers
            ancestors[tags, words] = [hashed(x) for x in above if hide is None or x.startswith("parent:") or hide.random() >= HIDDEN]
        names = [
            "bias", f"size:{min(8, len(text).bit_length())}", f"words:{min(6, len(all_words).bit_length())}", f"linked:{round(linked * 3)}",
            *(f"says:{w}" for w in few), *{f"says begins:{w[:BEGINNING]}" for w in few}, *(f"under:{w}" for w in heading), *{f"under begins:{w[:BEGINNING]}" for w in heading},
            f"stops:{min(3, sum(text.count(c) for c in '.!?'))}", f"commas:{min(2, text.count(','))}", f"rights:{'©' in text or 'rights reserved' in text.lower()}",
            f"ends:{text[-1] in '.!?…'}", f"place:{i * 4 // n}", f"first:{i == 0}", f"last:{i == n - 1}", f"capitals:{sum(map(str.isupper, [w[0] for w in all_words])) * 3 // len(all_words)}",
        ]
        out.append([*ancestors[tags, words], *around[i], *map(hashed, names)])
    return out


def labels_of(blocks: list[tuple]) -> list[int] | None:
    """What the page's own markup says about its blocks; None where it leaves doubt: no main element, or named elements inside it."""
    inside = [bool(MAIN_TAGS & set(tags)) for _, tags, _, _, _ in blocks]
    if not any(inside) or any(own and words for own, (_, _, words, _, _) in zip(inside, blocks, strict=True)):
        return None
    return [int(own and not OTHER_TAGS & set(tags)) for own, (_, tags, _, _, _) in zip(inside, blocks, strict=True)]


class Field:
    """Weights of a two-label linear chain."""

    def __init__(self):
        self.emit, self.move, self.start = np.zeros((FEATURES, 2)), np.zeros((2, 2)), np.zeros(2)

    def scores(self, features: list[list[int]]) -> np.ndarray:
        if not features:
            return np.zeros((0, 2))
        starts = np.cumsum([0, *map(len, features[:-1])])
        return np.add.reduceat(self.emit[list(chain.from_iterable(features))], starts, axis=0)

    def decode(self, features: list[list[int]]) -> list[int]:
        """The likeliest labels (Viterbi)."""
        if not features:
            return []
        scores = self.scores(features).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = self.start[0] + scores[0][0], self.start[1] + scores[0][1]
        back = []
        for s0, s1 in scores[1:]:
            from_a0, from_b0, from_a1, from_b1 = a + m00, b + m10, a + m01, b + m11
            back.append((from_b0 > from_a0, from_b1 > from_a1))
            a, b = max(from_a0, from_b0) + s0, max(from_a1, from_b1) + s1
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return out[::-1]

    def gradient(self, features: list[list[int]], labels: list[int]):
        """Gradient of one page's log-likelihood, by forward and backward sums: (per block and label, moves)."""
        s = self.scores(features)
        n = len(s)
        forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
        forward[0] = self.start + s[0]
        for i in range(1, n):
            forward[i] = np.logaddexp(forward[i - 1, 0] + self.move[0], forward[i - 1, 1] + self.move[1]) + s[i]
        for i in range(n - 2, -1, -1):
            ahead = backward[i + 1] + s[i + 1]
            backward[i] = np.logaddexp(self.move[:, 0] + ahead[0], self.move[:, 1] + ahead[1])
        total = np.logaddexp(*(forward[-1]))
        one = np.exp(forward + backward - total)
        truth = np.zeros((n, 2))
        truth[np.arange(n), labels] = 1
        moves = np.zeros((2, 2))
        if n > 1:
            two = np.exp(forward[:-1, :, None] + self.move[None] + (s[1:] + backward[1:])[:, None, :] - total)
            np.add.at(moves, (labels[:-1], labels[1:]), 1)
            moves -= two.sum(axis=0)
        return truth - one, moves

    def fit(self, pages: list[tuple[list[list[int]], list[int]]]) -> Field:
        """Penalised maximum likelihood by Adagrad over whole passes in a fixed order."""
        seen_emit, seen_move, seen_start = np.full_like(self.emit, 1e-6), np.full_like(self.move, 1e-6), np.full_like(self.start, 1e-6)
        for step in range(max(3, STEPS * 10 // (10 + len(pages)))):
            order = list(range(len(pages)))
            random.Random(step).shuffle(order)
            for p in order:
                features, labels = pages[p]
                blocks, moves = self.gradient(features, labels)
                at = np.concatenate([np.array(f) for f in features])
                g = np.repeat(blocks, [len(f) for f in features], axis=0)
                places, where = np.unique(at, return_inverse=True)
                sums = np.zeros((len(places), 2))
                np.add.at(sums, where, g)
                sums -= RIDGE * self.emit[places]
                seen_emit[places] += sums**2
                self.emit[places] += RATE * sums / np.sqrt(seen_emit[places])
                moves = moves - RIDGE * self.move
                seen_move += moves**2
                self.move += RATE * moves / np.sqrt(seen_move)
                seen_start += blocks[0] ** 2
                self.start += RATE * blocks[0] / np.sqrt(seen_start)
        return self


def by_hand(pages: list[str]) -> list[tuple[list[tuple], list[int]]]:
    """Blocks and labels of pages whose blocks begin with the label that was given by hand: + for main text, - for other."""
    out = []
    for html in pages:
        blocks = blocks_of(html)
        if any(b[0][0] not in "+-" for b in blocks):
            raise ValueError("a block without a label: " + html)
        out.append(([(b[0][1:].strip() or ".", *b[1:]) for b in blocks], [int(b[0][0] == "+") for b in blocks]))
    return out


def trained(known: list[tuple[list[tuple], list[int]]], certain: list[tuple[list[tuple], list[int]]]) -> Field:
    """A field trained on pages labelled by hand, each shown several times, and on pages labelled by their own markup."""
    hide = random.Random(7)
    return Field().fit([(features_of(b, hide), y) for b, y in [*known * SHOWN, *certain] if b])


def learn(pages: DataFrame) -> Field:
    """A field trained on the pages labelled by hand and at most LEARN_PAGES of the corpus."""
    usable = pages.where("html is not null").select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    # about twice as many by hash, then the first of these, so that no task hands the driver LEARN_PAGES of its own
    share = min(1.0, 2 * LEARN_PAGES / max(1, usable.count()))
    at = F.pmod(F.xxhash64("page_id", "html"), F.lit(1 << 40))
    rows = usable.withColumn("at", at).where(F.col("at") < int(share * (1 << 40))).orderBy("at", "html").limit(LEARN_PAGES).select("html").collect()
    certain = []
    for r in rows:
        blocks = blocks_of(r.html)
        if labels := labels_of(blocks):
            certain.append((blocks, labels))
    return trained(by_hand(PAGES), certain)


def main_text(html: str, field: Field) -> str:
    """Main blocks of a page, white space in each turned into single spaces, joined by an empty line."""
    blocks = blocks_of(html)
    return "\n\n".join(b[0] for b, keep in zip(blocks, field.decode(features_of(blocks)), strict=True) if keep)


def extracted(pages: DataFrame, field: Field) -> DataFrame:
    """page_id, url, text, n_chars, a row for each row of pages.

    Null or empty html, and pages without a main block, give an empty text. Broken markup is read as far as it goes.
    Repeated rows are each read; null ids and urls stay null; an empty table gives no rows; other columns are not read.
    """
    prepare(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        for batch in batches:
            texts = [main_text(h, shared.value) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return chosen.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    pages = read(spark, sf_dir, "pages")
    return extracted(pages, learn(pages))
