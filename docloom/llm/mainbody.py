"""Problem 5: page boilerplate and main body, by gradient-boosted trees over the nodes of a page's tree.

The blocks of parsed_content are the nodes: a heading is the parent of its section, a list the parent of its items, which
nest by depth. Features (``features``) are a node's own text, its tag and attribute tokens, its subtree (length, share of
bare links and of sentences), its depth, its siblings, its place, and how far its text repeats over the corpus: the share
of pages, in its crate and in all, that hold its template (text with names and numbers masked), the shares of pages that
hold its runs of three words, and how often headings of its wording stand right over a list. Repetition is counted over
all pages.

There are no labelled pages, so the trees are fitted on weak labels of a bounded sample (``sample_pages``). The label
rules (``weak_labels``) know no wording: they speak of what repeats, of code marks and of where lists stand, and keep
silent where they aren't sure. In a second round the trees are fitted again on labels that the first ones, fitted on
other pages, confirm or decide themselves, so that trees overrule rules. Decoding is hierarchical (``decode``): of all
choices without a contradiction between a node and what stands under it the likeliest is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import words
from docloom.llm.boosting import Boosted, fit
from docloom.runtime import materialize

KINDS = ("paragraph", "list_item", "heading", "code_block", "definition_term", "definition_desc")
PARAGRAPH, ITEM, HEADING, CODE = 0, 1, 2, 3
#: Numbers in each of the two tables of word runs.
BITS = 20
_NAME = r"\b[a-z]+_[a-z_]+\b|\b[A-Z][a-z]+(?:[A-Z]\w*)+"
_PARTS = r" (?:»|›|>|/|·|::|\||•) |  +"
_KEYS = 4  # template in the crate and in all, the same right over a list


@dataclass(frozen=True)
class BodySettings:
    """``sample_pages``: pages at most, about, on which the trees are fitted. A template counts from ``least_pages`` pages and ``least_share`` of a crate's pages on and is surely repeated from ``sure_share`` on. ``confident``: log odds from which the second round takes the first one's word. ``part``: share of the rows that each tree sees."""

    sample_pages: int = 2000
    least_pages: int = 8
    least_share: float = 0.005
    sure_share: float = 0.02
    confident: float = 1.5
    trees: int = 60
    depth: int = 4
    part: float = 0.2


def _word_class() -> np.ndarray:
    """Letters, digits, the bar and all bytes beyond ASCII make words, so that ornaments count, and so do the marks of a block's begin and end."""
    table = words.word_class("|\x01\x02")
    table[128:] = True
    return table


_CLASS = _word_class()


@dataclass
class Blocks:
    """The blocks of some pages, one after the other; ``start`` has where each page begins, and the end."""

    start: np.ndarray
    crate: np.ndarray  # a hash for each page
    kind: np.ndarray
    text: pa.Array
    tag: pa.Array
    level: np.ndarray
    depth: np.ndarray
    path: np.ndarray
    anchor: pa.Array

    def __post_init__(self) -> None:
        masked = pc.utf8_lower(pc.replace_substring_regex(pc.replace_substring_regex(self.text, _NAME, "x"), r"\d+", "0"))
        masked = pc.binary_join_element_wise("\x01", masked, "\x02", " ")
        self.word, self.owner, _, _ = words.words(masked, _CLASS)
        self.page = np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))
        n = len(self.kind)
        first = np.searchsorted(self.owner, np.arange(n + 1))
        self.words = np.diff(first)
        place = np.arange(len(self.owner)) - first[self.owner]
        parts = words.mix(self.word + place.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
        self.template = _sums(parts, first, n)
        self.run, at = words.shingles(self.word, self.owner, 3)
        self.run_owner = self.owner[at]
        self.over_list = np.zeros(n, bool)
        if n:
            same = self.page[1:] == self.page[:-1]
            self.over_list[:-1] = same & (self.kind[:-1] == HEADING) & (self.kind[1:] == ITEM)

    def keys(self) -> np.ndarray:
        """(blocks, _KEYS) keys of shares."""
        own = words.mix(self.template ^ words.mix(self.kind.astype(np.uint64) + np.uint64(77)))
        over = words.mix(own ^ np.uint64(0x5851F42D4C957F2D))
        crate = self.crate[self.page]
        return np.stack((in_crate(own, crate), own, in_crate(over, crate), over), axis=1)


def in_crate(key: np.ndarray, crate: np.ndarray) -> np.ndarray:
    return words.mix(key ^ crate)


def _sums(values: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """Sums of the stretches that begin at ``first``; an empty stretch gives 0."""
    total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values)))
    return total[first[1:]] - total[first[:-1]]


def crate_hash(crate: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(crate)


_COLUMNS = ("block_type", "html_tag", "text", "heading_level", "list_depth", "paths", "anchor")


def blocks_of(batch: pa.RecordBatch | pa.Table) -> Blocks:
    def flat(name: str) -> pa.Array:
        column = batch.column(name)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return column.flatten()

    def number(name: str) -> np.ndarray:
        return flat(name).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.float32)

    sizes = pc.list_value_length(batch.column("text")).to_numpy(zero_copy_only=False)
    start = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    kind = pc.index_in(flat("block_type"), value_set=pa.array(KINDS)).fill_null(len(KINDS)).to_numpy(zero_copy_only=False).astype(np.int64)
    crate = np.array([crate_hash(c or "") for c in batch.column("crate").to_pylist()], np.uint64)
    return Blocks(start, crate, kind, flat("text").fill_null(""), flat("html_tag").fill_null(""), number("heading_level"), number("list_depth"), np.maximum(number("paths"), 0), flat("anchor").fill_null(""))


@dataclass
class Lists:
    """Runs of list items: (start, end) in the blocks, and for each block the list it belongs to or -1."""

    start: np.ndarray
    end: np.ndarray
    of: np.ndarray


def lists_of(b: Blocks) -> Lists:
    item = b.kind == ITEM
    fresh = item.copy()
    fresh[1:] &= ~(item[:-1] & (b.page[1:] == b.page[:-1]))
    of = np.where(item, np.cumsum(fresh) - 1, -1)
    start = np.flatnonzero(fresh)
    end = start + np.bincount(of[item], minlength=len(start)) if len(start) else start
    return Lists(start, end, of)


def run_buckets(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of a run of words in either table."""
    high = np.uint64(64 - BITS)
    return (runs >> high).astype(np.int64), (words.mix(runs ^ np.uint64(0x2545F4914F6CDD1D)) >> high).astype(np.int64) + (1 << BITS)


@dataclass
class Repeats:
    """Shares of pages: of word runs in two tables of fixed size, of which the smaller number holds, and of templates by key, unless these are too many and joined."""

    runs: np.ndarray
    pages: int
    keys: np.ndarray | None = None
    shares: np.ndarray | None = None

    def of_keys(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(keys.shape)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.shares[at], 0.0)

    def of_runs(self, runs: np.ndarray) -> np.ndarray:
        one, two = run_buckets(runs)
        return np.minimum(self.runs[one], self.runs[two])


@dataclass
class Marks:
    """What label rules and features both look at."""

    coded: np.ndarray  # holds a code mark
    sentence: np.ndarray  # six blanks or more
    rich: np.ndarray  # either of them
    top: np.ndarray  # for each block its page's first h1, or the page's start
    has_top: np.ndarray
    lists: Lists
    list_rich: np.ndarray  # for each list the share of its rich items
    at: np.ndarray  # place in the page
    size: np.ndarray  # in code points
    parts: np.ndarray  # stretches of the text between separators
    frequent: np.ndarray  # share of the runs of words that many pages hold


def marks_of(b: Blocks, repeats: Repeats, settings: BodySettings) -> Marks:
    n = len(b.kind)
    spaces = pc.count_substring(b.text, " ").to_numpy(zero_copy_only=False)
    coded = pc.match_substring_regex(b.text, r"`|\w::\w").to_numpy(zero_copy_only=False)
    sentence = spaces >= 6
    rich = coded | sentence
    h1 = np.flatnonzero(pc.equal(b.tag, "h1").to_numpy(zero_copy_only=False)) if n else np.zeros(0, int)
    pages = len(b.start) - 1
    first = np.full(pages, -1)
    first[b.page[h1[::-1]]] = h1[::-1]
    has = first >= 0
    top = np.where(has, first, b.start[:-1])
    lists = lists_of(b)
    share = _sums(rich.astype(float), np.append(lists.start, len(rich)), len(lists.start)) if len(lists.start) else np.zeros(0)
    if len(lists.start):
        inside = np.flatnonzero(lists.of >= 0)
        share = np.bincount(lists.of[inside], rich[inside], len(lists.start)) / (lists.end - lists.start)
    size = np.maximum(pc.utf8_length(b.text).to_numpy(zero_copy_only=False), 1)
    parts = pc.count_substring_regex(b.text, _PARTS).to_numpy(zero_copy_only=False) + 1
    # reworked copies of one page are no repetition of a notice: a run needs twice the pages of a template
    least = max(settings.least_share, 2 * settings.least_pages / max(repeats.pages, 1))
    frequent = _spread((repeats.of_runs(b.run) >= least).astype(float), b.run_owner, n)[0]
    return Marks(coded, sentence, rich, top[b.page], has[b.page], lists, share, np.arange(n) - b.start[:-1][b.page], size, parts, frequent)


def _list_ratio(shares: np.ndarray) -> np.ndarray:
    """How often headings of this wording stand right over a list, in the crate, else in all; -1 where the wording is rare."""
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(shares[:, 1] > 0, shares[:, 3] / shares[:, 1], -1.0)


def weak_labels(b: Blocks, m: Marks, shares: np.ndarray, settings: BodySettings) -> np.ndarray:
    """1 for boilerplate, 0 for the subject, -1 where no rule is sure.

    Boilerplate: paragraphs without code marks whose template or whose runs of words surely repeat, short parts between
    separators at the head of a page, and bare lists before the title or under a heading whose wording mostly stands
    right over lists, with that heading. Subject: code, definitions, the title, paragraphs with code marks or of some
    length whose template (and, without code marks, whose runs of words) is rare, lists of mostly rich items, and headings over such
    paragraphs."""
    n = len(b.kind)
    out = np.full(n, -1)
    out[(b.kind >= CODE) & (b.kind < len(KINDS))] = 0
    paragraph = b.kind == PARAGRAPH
    repeats = shares[:, :2].max(axis=1) >= settings.sure_share
    rare = shares[:, :2].max(axis=1) == 0
    out[paragraph & rare & (m.coded & m.sentence | (m.size >= 150) & (m.frequent < 0.6))] = 0
    out[paragraph & ~m.coded & (repeats | (m.frequent >= 0.6))] = 1
    early = np.where(m.has_top, np.arange(n) < m.top + 2, m.at < 2)
    out[paragraph & ~m.coded & early & (m.parts >= 3) & (b.words <= 4 * m.parts)] = 1
    ratio = _list_ratio(shares)
    for k, (start, end) in enumerate(zip(m.lists.start, m.lists.end)):
        before = start - 1 if start > b.start[b.page[start]] else -1
        if m.list_rich[k] > 0.5:
            out[start:end] = 0
        elif m.list_rich[k] == 0 and before >= 0 and b.kind[before] == HEADING and ratio[before] > 0.75:
            out[before:end] = 1
        elif m.list_rich[k] == 0 and m.has_top[start] and end <= m.top[start]:
            out[start:end] = 1
        elif m.list_rich[k] > 0 and before >= 0 and out[before] == 0:
            out[start:end] = 0
    over = np.zeros(n, bool)
    over[:-1] = (b.kind[:-1] == HEADING) & (out[1:] == 0) & (b.page[1:] == b.page[:-1]) & (b.kind[1:] != ITEM)
    out[over & (ratio < 0.5)] = 0
    out[m.has_top & (np.arange(n) == m.top)] = 0
    return out


@dataclass
class Weights:
    """Log odds of words to stand in boilerplate, by hash."""

    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    odds: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def of(self, word: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(word))
        at = np.minimum(np.searchsorted(self.hashes, word), len(self.hashes) - 1)
        return np.where(self.hashes[at] == word, self.odds[at], 0.0)


def weights_of(word: np.ndarray, owner: np.ndarray, labels: np.ndarray, least: int = 5) -> Weights:
    """Smoothed log odds over the labelled owners, each word once an owner."""
    known = labels[owner] >= 0
    word, owner = words.sets(word[known], owner[known])
    if not len(word):
        return Weights()
    hashes, at = np.unique(word, return_inverse=True)
    y = labels[owner].astype(float)
    hit, n = np.bincount(at, y), np.bincount(at)
    total = np.bincount(labels[labels >= 0], minlength=2)
    odds = np.log((hit + 0.5) / (total[1] + 1)) - np.log((n - hit + 0.5) / (total[0] + 1))
    return Weights(hashes[n >= least], odds[n >= least])


def _spread(values: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, most, least) of the values of each owner, 0 where it has none; owners ascend."""
    out = np.zeros((3, n))
    if len(values):
        start = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        at = owner[start]
        out[0, at] = np.add.reduceat(values, start) / np.diff(np.append(start, len(values)))
        out[1, at] = np.maximum.reduceat(values, start)
        out[2, at] = np.minimum.reduceat(values, start)
    return out[0], out[1], out[2]


def _attributes(b: Blocks) -> tuple[np.ndarray, np.ndarray]:
    """(hash, block) of the attribute tokens: tag, level, and the words of the anchor."""
    level = pa.array(b.level.astype(np.int64).astype(str))
    tokens = pc.utf8_lower(pc.binary_join_element_wise(b.tag, pc.binary_join_element_wise(b.tag, level, "l"), pc.replace_substring_regex(b.anchor, r"\d+", "0"), " "))
    word, owner, _, _ = words.words(tokens, words.word_class("_"))
    return word, owner


def _named(b: Blocks, m: Marks) -> np.ndarray:
    """2 where a longer text ends with its page's title, 1 where it holds it elsewhere."""
    out = np.zeros(len(b.kind))
    text = b.text.to_pylist()
    for k in np.flatnonzero(m.has_top & (b.kind == PARAGRAPH)):
        if (title := text[m.top[k]].strip()) and title in (own := text[k].rstrip()):
            out[k] = 0 if own == title else 2 if own.endswith(title) else 1
    return out


#: Numbers of a block itself among ``features``, and the columns that tell how much a block repeats, and where and after what it stands.
OWN = 37
REPEATED = [*range(23, 29)]
PLACED = [29, 32, *range(OWN, OWN + 5), *range(OWN + 12, OWN + 28)]


def features(b: Blocks, m: Marks, shares: np.ndarray, repeats: Repeats, word_odds: Weights, attribute_odds: Weights) -> np.ndarray:
    """One row of numbers for each block."""
    n = len(b.kind)

    def count(pattern: str) -> np.ndarray:
        return pc.count_substring_regex(b.text, pattern).to_numpy(zero_copy_only=False)

    size = m.size
    numbered = pc.match_substring_regex(b.text, r"^\d+\.\d+ |^[Aa]ll ").to_numpy(zero_copy_only=False)
    ends = pc.match_substring_regex(b.text, r"[.。]\s*$").to_numpy(zero_copy_only=False)
    tag_level = pc.if_else(pc.match_substring_regex(b.tag, "^h[1-6]$"), pc.utf8_slice_codeunits(b.tag, 1, 2), "-1").cast(pa.int32()).to_numpy(zero_copy_only=False)
    odds = _spread(word_odds.of(b.word), b.owner, n)
    attributes = _spread(attribute_odds.of((at := _attributes(b))[0]), at[1], n)
    run = repeats.of_runs(b.run)
    runs = _spread(np.log(run + 1e-4), b.run_owner, n)
    title = np.where(m.has_top, b.template[np.minimum(m.top, max(n - 1, 0))], 0) if n else np.zeros(0)
    own = np.stack((
        b.kind, np.log(size), b.words, count(r"\."), count(","), count("`"), count("::"), count("_"), m.parts, b.words / m.parts, count("[·|»›←→«★☆©]"), count("[?!]"), count(":"),
        count(r"\d") / size, count("[A-Z]") / size, ends, numbered, *odds, *attributes, m.frequent, *runs, shares[:, 0], shares[:, 1], _list_ratio(shares), b.level, b.depth, b.path,
        pc.utf8_length(b.anchor).to_numpy(zero_copy_only=False) > 0, (tag_level > 0) & (tag_level != b.level), b.template == title, _named(b, m),
    ), axis=1).astype(np.float32)
    pages = b.start[1:] - b.start[:-1]
    count_of = pages[b.page]
    place = np.stack((m.at, m.at / np.maximum(count_of - 1, 1), count_of - m.at, np.where(m.has_top, np.clip(np.arange(n) - m.top, -20, 20), -21), m.has_top & (np.arange(n) < m.top)), axis=1).astype(np.float32)

    # a list as the parent of its items: how many, how rich, how long, how deep
    of, lists = m.lists.of, len(m.lists.start)
    inside = np.flatnonzero(of >= 0)

    def by_list(values: np.ndarray) -> np.ndarray:
        return np.bincount(of[inside], values[inside], lists) / np.maximum(m.lists.end - m.lists.start, 1) if lists else np.zeros(0)

    listed = np.full((n, 9), -1, np.float32)
    if lists:
        start, before = m.lists.start, np.maximum(m.lists.start - 1, 0)
        inner = b.page[before] == b.page[start]
        inner &= start > 0
        rows = np.stack((m.lists.end - start, m.list_rich, by_list(m.coded), by_list(m.sentence), by_list(size), by_list(numbered), by_list(b.depth), np.where(inner, b.kind[before], -1), np.where(inner, odds[0][before], 0)), axis=1)
        listed[inside] = rows[of[inside]]
        over = np.flatnonzero(b.over_list)
        listed[over] = rows[of[over + 1]]

    # a heading as the parent of its section: its subtree reaches to the next heading
    section = np.cumsum((b.kind == HEADING) | (m.at == 0)) - 1 if n else np.zeros(0, int)
    sections = int(section[-1]) + 1 if n else 0

    def by_section(values: np.ndarray) -> np.ndarray:
        return np.bincount(section, values, sections)[section] if n else np.zeros(0)

    link = (b.kind == ITEM) & ~m.rich
    length = by_section(size)
    subtree = np.stack((by_section(np.ones(n)), np.log(length) if n else length, by_section(link * size) / np.maximum(length, 1), by_section(m.rich * size) / np.maximum(length, 1), by_section(b.kind == CODE)), axis=1).astype(np.float32)

    def beside(step: int) -> np.ndarray:
        """Some of the numbers of the block before or after on the same page."""
        picked = own[:, [0, 1, 5, 17, 23, 24, 27, 28, 29]]
        out = np.full(picked.shape, -2, np.float32)
        if n > 1:
            same = b.page[1:] == b.page[:-1]
            to, frm = (np.flatnonzero(same) + 1, np.flatnonzero(same)) if step < 0 else (np.flatnonzero(same), np.flatnonzero(same) + 1)
            out[to] = picked[frm]
        return out

    return np.concatenate((own, place, listed, subtree, beside(-1), beside(1)), axis=1)


def decode(b: Blocks, m: Marks, odds: np.ndarray) -> np.ndarray:
    """Whether each block falls: the likeliest choice in which code, definitions and the title stay, items of one list fall together, a heading right over a list falls with it, and any other heading falls only with all that stands under it, up to the next heading that isn't deeper."""
    odds = np.clip(odds, -8.0, 8.0)
    fixed = (b.kind >= CODE) & (b.kind < len(KINDS))
    fixed[m.top[m.has_top]] = True
    out = (odds > 0) & ~fixed
    of = m.lists.of
    inside = np.flatnonzero(of >= 0)
    lists = len(m.lists.start)
    means = np.bincount(of[inside], odds[inside], lists) / np.maximum(m.lists.end - m.lists.start, 1) if lists else np.zeros(0)
    head = np.where(np.append(b.over_list, False)[m.lists.start - 1] & (m.lists.start > 0), m.lists.start - 1, -1) if lists else np.zeros(0, int)
    head = np.where((head >= 0) & ~fixed[np.maximum(head, 0)], head, -1)
    falls = means + np.where(head >= 0, odds[np.maximum(head, 0)], 0.0) > 0
    out[inside] = falls[of[inside]]
    out[head[head >= 0]] = falls[head >= 0]
    cost = np.where(fixed, np.inf, np.maximum(-odds, 0.0))  # of letting a block fall that stays by itself
    for k in np.flatnonzero((b.kind == HEADING) & ~b.over_list & out)[::-1]:
        end, stop = k + 1, b.start[b.page[k] + 1]
        while end < stop and (b.kind[end] != HEADING or b.level[end] > b.level[k] or b.over_list[end]):
            end += 1
        stays = ~out[k + 1 : end]
        if odds[k] > cost[k + 1 : end][stays].sum():
            out[k:end] = True
        else:
            out[k] = False
    return out


@dataclass
class BodyModel:
    """Trees, words and attributes; None for trees where the corpus gave no labels of either kind."""

    trees: Boosted | None
    word_odds: Weights
    attribute_odds: Weights
    settings: BodySettings

    def label(self, b: Blocks, shares: np.ndarray, repeats: Repeats) -> np.ndarray:
        """Whether each block is boilerplate; nothing is where there are no trees."""
        if self.trees is None or not len(b.kind):
            return np.zeros(len(b.kind), bool)
        m = marks_of(b, repeats, self.settings)
        return decode(b, m, self.trees.predict(features(b, m, shares, repeats, self.word_odds, self.attribute_odds)))


def _blinded(x: np.ndarray, columns: list[int]) -> np.ndarray:
    """``x`` with some columns of each row taken from another row."""
    out = x.copy()
    out[:, columns] = x[np.random.default_rng(7).permutation(len(x))][:, columns]
    return out


def train(b: Blocks, shares: np.ndarray, repeats: Repeats, settings: BodySettings = BodySettings()) -> BodyModel:
    """Two rounds: each half of the pages is judged by trees fitted on the rules' labels of the other half; where these are confident, their word replaces the rules' or breaks their silence.

    Each labelled row enters three times, twice with what rules look at taken from another row (how much it repeats; where
    it stands), so that trees learn what else tells the kinds apart and can decide where rules have nothing to go by."""
    m = marks_of(b, repeats, settings)
    labels = weak_labels(b, m, shares, settings)

    def fitted(y: np.ndarray, rows: np.ndarray) -> BodyModel:
        known = np.where(rows, y, -1)
        if not (known == 0).any() or not (known == 1).any():
            return BodyModel(None, Weights(), Weights(), settings)
        text = np.where((b.kind == PARAGRAPH) | (b.kind == HEADING), known, -1)
        odds, attributes = weights_of(b.word, b.owner, text), weights_of(*_attributes(b), known)
        x = features(b, m, shares, repeats, odds, attributes)[known >= 0]
        y = known[known >= 0].astype(float)
        x = np.concatenate((x, *(_blinded(x, columns) for columns in (REPEATED, PLACED))))
        return BodyModel(fit(x, np.tile(y, 3), settings.trees, settings.depth, part=settings.part), odds, attributes, settings)

    better = labels.copy()
    for half in (0, 1):
        first = fitted(labels, b.page % 2 != half)
        if first.trees is None:
            continue
        judged = first.trees.predict(features(b, m, shares, repeats, first.word_odds, first.attribute_odds))
        sure = (np.abs(judged) >= settings.confident) & (b.page % 2 == half)
        better[sure] = judged[sure] > 0
    better[(b.kind >= CODE) & (b.kind < len(KINDS))] = 0
    return fitted(better, np.ones(len(better), bool))


def _select(pages: DataFrame) -> DataFrame:
    """Only the fields that are used leave the scan."""
    b = "parsed_content"
    return pages.select(
        F.col("pk").cast("long"), F.coalesce("crate", F.lit("")).alias("crate"), F.col(f"{b}.block_type").alias("block_type"), F.col(f"{b}.html_tag").alias("html_tag"), F.col(f"{b}.text").alias("text"),
        F.col(f"{b}.heading_level").alias("heading_level"), F.col(f"{b}.list_depth").alias("list_depth"), F.transform(f"{b}.section_path", lambda p: F.size(p)).alias("paths"), F.col(f"{b}.anchor").alias("anchor"),
    ).filter((F.size("text") > 0) & F.col("pk").isNotNull())


#: Pages that are worked on at a time.
SLICE = 500
#: Shares of templates, and ids delivered more than once, up to which they are broadcast; beyond, they are joined.
BROADCAST_ROWS = 200_000


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE):
            yield batch.slice(lo, SLICE)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _slices(batches):
        b = blocks_of(part)
        keys = b.keys()
        key = np.concatenate((keys[:, 1], keys[b.over_list, 3])).view(np.int64)
        page = np.concatenate((b.page, b.page[b.over_list]))
        rows = np.unique(np.stack((page, key), axis=1), axis=0)
        at = pa.array(rows[:, 0])
        yield pa.RecordBatch.from_arrays([part.column("crate").take(at), pa.array(rows[:, 1]), part.column("pk").take(at)], names=["crate", "key", "pk"])


def _crate_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crate = np.array([crate_hash(c) for c in batch.column("crate").to_pylist()], np.uint64)
        key = in_crate(batch.column("key").to_numpy().view(np.uint64), crate)
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("share")], names=["key", "share"])


def template_shares(blocks: DataFrame, total: int, settings: BodySettings = BodySettings()) -> DataFrame:
    """(key, share): the share of pages that hold a template, or a heading's template right over a list, by keys of a crate and of all. Of a crate, at most (blocks a page) / least_share templates are kept."""
    seen = blocks.mapInArrow(_keys, "crate string, key long, pk long").distinct()
    counted = seen.groupBy("crate", "key").agg(F.count(F.lit(1)).alias("n"))
    pages = blocks.select("pk", "crate").distinct().groupBy("crate").agg(F.count(F.lit(1)).alias("pages"))
    mine = counted.filter(F.col("n") >= settings.least_pages).join(pages, "crate").select("crate", "key", (F.col("n") / F.col("pages")).alias("share"))
    mine = mine.filter(F.col("share") >= settings.least_share).mapInArrow(_crate_keys, "key long, share double")
    every = counted.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= settings.least_pages)
    every = every.select("key", (F.col("n") / total).alias("share")).filter(F.col("share") >= settings.least_share)
    return mine.unionByName(every)


def run_shares(blocks: DataFrame, total: int) -> np.ndarray:
    """The two tables of ``Repeats.runs``. Every page counts its runs once; a page delivered n times counts 1/n each time. What reaches the driver is at most one row for each of the tables' numbers."""
    again = materialize(blocks.groupBy("pk").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "p5-again")
    n = again.count()
    counted = blocks.withColumn("n", F.lit(1).cast("long"))
    if n:
        counted = blocks.join(F.broadcast(again) if n <= BROADCAST_ROWS else again, "pk", "left").withColumn("n", F.coalesce("n", F.lit(1).cast("long")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(2 << BITS)
        for part in _slices(batches):
            b = blocks_of(part)
            runs, page = words.sets(b.run, b.page[b.run_owner])
            weight = 1.0 / part.column("n").to_numpy()[page]
            for at in run_buckets(runs):
                held += np.bincount(at, weight, 2 << BITS)
        full = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(held[full])], names=["bucket", "pages"])

    table = counted.mapInArrow(run, "bucket int, pages double").groupBy("bucket").agg(F.sum("pages").alias("pages")).toArrow()
    out = np.zeros(2 << BITS, np.float32)
    out[table.column("bucket").to_numpy()] = table.column("pages").to_numpy() / max(total, 1)
    return out


def _block_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _slices(batches):
        b = blocks_of(part)
        page = pa.array(np.repeat(b.page, _KEYS))
        at = np.arange(len(b.kind) * _KEYS) - np.repeat(b.start[:-1][b.page] * _KEYS, _KEYS)
        yield pa.RecordBatch.from_arrays([part.column("pk").take(page), part.column("digest").take(page), pa.array(at.astype(np.int32)), pa.array(b.keys().ravel().view(np.int64))], names=["pk", "digest", "at", "key"])


def with_shares(blocks: DataFrame, kept: DataFrame) -> DataFrame:
    """Adds ``shares``, _KEYS numbers for each block, by a shuffle join on the keys."""
    blocks = blocks.withColumn("digest", F.xxhash64("crate", "block_type", "text"))
    rows = blocks.mapInArrow(_block_keys, "pk long, digest long, at int, key long").distinct()
    found = rows.join(kept, "key", "left").groupBy("pk", "digest").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("share", F.lit(0.0)).alias("share")))).alias("s"))
    return blocks.join(found.select("pk", "digest", F.transform("s", lambda x: x["share"]).alias("shares")), ["pk", "digest"]).drop("digest")


def _shares(part: pa.RecordBatch | pa.Table, b: Blocks, repeats: Repeats) -> np.ndarray:
    if repeats.keys is not None:
        return repeats.of_keys(b.keys())
    column = part.column("shares")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(-1, _KEYS)


def _fitted(pages: DataFrame, settings: BodySettings) -> tuple[DataFrame, BodyModel, Repeats] | None:
    """(blocks, model, repeats); None for a table without blocks."""
    blocks = _select(pages)
    total = blocks.select("pk").distinct().count()
    if not total:
        return None
    kept = materialize(template_shares(blocks, total, settings), "p5-templates")
    repeats = Repeats(run_shares(blocks, total), total)
    if kept.count() <= BROADCAST_ROWS:
        table = kept.toArrow()
        keys = table.column("key").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        repeats.keys, repeats.shares = keys[order], table.column("share").to_numpy()[order]
    else:
        blocks = materialize(with_shares(blocks, kept), "p5-shares")
    bound = int(min(1.0, settings.sample_pages / total) * ((1 << 62) - 1))
    sample = blocks.filter(F.shiftrightunsigned(F.xxhash64("pk"), 2) <= bound).dropDuplicates(["pk"]).orderBy("pk").toArrow()
    labelled = blocks_of(sample)
    return blocks, train(labelled, _shares(sample, labelled, repeats), repeats, settings), repeats


def boilerplate_blocks(pages: DataFrame, settings: BodySettings = BodySettings()) -> DataFrame:
    """(pk, block_no) of the blocks that aren't the subject of ``pages`` (pk, crate, parsed_content).

    Defined cases: a page without blocks (null or empty) has no rows; null texts, tags and types count as empty; a
    repeated delivery counts once, and where deliveries differ the blocks of each count; a row without an id takes no part; a page of any length is decided as a whole; log odds of exactly 0 stay; a table
    whose pages give the label rules nothing to call boilerplate, or no subject, has an empty result, and so has an empty table; other columns are ignored."""
    spark = pages.sparkSession
    if (found := _fitted(pages, settings)) is None or found[1].trees is None:
        return spark.createDataFrame([], "pk long, block_no long")
    blocks, model, repeats = found
    shared = spark.sparkContext.broadcast((model, repeats))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            b = blocks_of(part)
            hit = np.flatnonzero(shared.value[0].label(b, _shares(part, b, shared.value[1]), shared.value[1]))
            page = b.page[hit]
            yield pa.RecordBatch.from_arrays([part.column("pk").take(pa.array(page)), pa.array(hit - b.start[page])], names=["pk", "block_no"])

    return blocks.mapInArrow(run, "pk long, block_no long").distinct()


def decisions(pages: DataFrame, settings: BodySettings = BodySettings()) -> DataFrame:
    """(rule, decided, blocks): how many blocks the label rules call boilerplate (1), subject (0) or nothing (-1), and what was decided of them (1 or 0). Repeated deliveries count as often as they come."""
    spark = pages.sparkSession
    if (found := _fitted(pages, settings)) is None:
        return spark.createDataFrame([], "rule int, decided int, blocks long")
    blocks, model, repeats = found
    shared = spark.sparkContext.broadcast((model, repeats))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shares_of = shared.value
        counts = np.zeros((3, 2), np.int64)
        for part in _slices(batches):
            b = blocks_of(part)
            shares = _shares(part, b, shares_of)
            rule = weak_labels(b, marks_of(b, shares_of, own.settings), shares, own.settings)
            np.add.at(counts, (rule + 1, own.label(b, shares, shares_of).astype(int)), 1)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -1, 0, 0, 1, 1], pa.int32()), pa.array([0, 1] * 3, pa.int32()), pa.array(counts.ravel())], names=["rule", "decided", "blocks"])

    return blocks.mapInArrow(run, "rule int, decided int, blocks long").groupBy("rule", "decided").agg(F.sum("blocks").alias("blocks"))


def main_body(pages: DataFrame, settings: BodySettings = BodySettings()) -> DataFrame:
    """(pk, blocks) with the blocks of the subject only, one row for each page."""
    gone = materialize(boilerplate_blocks(pages, settings), "p5-blocks").groupBy("pk").agg(F.collect_set("block_no").alias("gone"))
    joined = pages.select(F.col("pk").cast("long"), "parsed_content").dropDuplicates(["pk"]).join(gone, "pk", "left")
    kept = F.filter("parsed_content", lambda b, k: ~F.coalesce(F.array_contains("gone", k.cast("long")), F.lit(False)))
    return joined.select("pk", kept.alias("blocks"))
