"""Main text of web pages by a recurrent labeller of blocks."""

from __future__ import annotations

import html
import random
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import small_batches

#: Elements that break text into blocks (fixed values).
BREAKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frame "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre search section select "
    "summary svg table tbody td template textarea tfoot th thead title tr ul video".split()
)
#: Elements without content, and those whose content is no markup (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
#: Elements never shown as text.
HIDDEN = frozenset("script style template noscript head iframe object svg math".split())
#: Open elements that a start tag closes (fixed values).
CLOSES = {x: frozenset("p".split()) for x in BREAKS - {"br", "button", "option", "select", "body", "html", "head"}} | {
    "li": frozenset("p li".split()), "dd": frozenset("p dd dt".split()), "dt": frozenset("p dd dt".split()), "option": frozenset(["option"]),
    "tr": frozenset("p tr td th".split()), "td": frozenset("p td th".split()), "th": frozenset("p td th".split()), "body": frozenset(["head"]),
}
#: Elements that a start tag's closing does not reach beyond.
WALLS = frozenset("article aside body button div dl footer form header html main nav ol section table ul".split())

MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?>[^>"']+|"[^"]*"|'[^']*')*+)>|<[a-zA-Z/!?][^>]*(?:>|\Z)""", re.S
)
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)")
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME = re.compile(r"[a-z]+")

PATH, WORDS, SHAPE = 96, 32, 8
HIDDEN_UNITS = 16
#: Bounds of the sample of pages that joins the made ones in training.
SAMPLE_PAGES, SAMPLE_CHARS, MADE_PAGES = 200, 40_000, 500
#: Blocks of a sampled page that are one example; its other blocks are others.
TRAINED_BLOCKS = 150


@dataclass
class Block:
    path: tuple[str, ...]  # the open elements: tag and names, joined by blanks
    text: str
    linked: int = 0


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order: runs of text between breaking tags, with their open elements.

    References are decoded, white space is one space, blocks without text are left out.
    Unclosed and unopened tags are mended: an end tag closes the nearest open element of
    its name, and is dropped if there is none.
    """
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    linked = hidden = links = at = 0

    def flush():
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(tuple(x for _, x in stack), text, linked))
            parts, linked = [], 0

    def add(piece: str):
        nonlocal linked
        if piece and not hidden:
            piece = html.unescape(piece) if "&" in piece else piece
            parts.append(piece)
            if links:
                linked += len(piece)

    def shut(depth: int):
        nonlocal hidden, links
        for tag, _ in stack[depth:]:
            hidden -= tag in HIDDEN
            links -= tag == "a"
        del stack[depth:]

    n = len(page)
    while at < n:
        m = MARKUP.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        end, tag, rest = m["end"], m["tag"], m["rest"]
        if tag is None:
            loose = LOOSE.match(m[0]) if m[0][1] not in "!?" and m[0].endswith(">") else None
            if m[0].startswith("<![CDATA["):
                add(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            if not loose:
                continue
            end, tag, rest = loose[1], loose[2], loose[3]
        tag = tag.lower()
        if tag in BREAKS:
            flush()
        if end:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    if any(x in BREAKS for x, _ in stack[depth:]):
                        flush()
                    shut(depth)
                    break
            continue
        closes = CLOSES.get(tag)
        if closes:
            for depth in range(len(stack) - 1, -1, -1):
                own = stack[depth][0]
                if own in closes:
                    shut(depth)
                elif own in WALLS:
                    break
        if tag in VOID:
            continue
        names = [x for k in NAMES.findall(rest) for x in NAME.findall((k[1] or k[2] or k[3]).lower())] if "=" in rest else []
        stack.append((tag, " ".join([tag, *names])))
        hidden += tag in HIDDEN
        links += tag == "a"
        if tag in RAW:
            stop = re.compile(rf"</{tag}\s*(?:>|/|\Z)", re.I).search(page, at)
            stop_at = stop.start() if stop else n
            add(page[at:stop_at])
            at = stop_at
    flush()
    return out


_PATHS: dict = {}


def path_vector(path: tuple[str, ...]) -> np.ndarray:
    """Hashed names of the open elements, nearer ones heavier."""
    known = _PATHS.get(path)
    if known is None:
        if len(_PATHS) > 50_000:
            _PATHS.clear()
        known = np.zeros(PATH, np.float32)
        for depth, names in enumerate(path[::-1]):
            for k, name in enumerate(names.split()):
                known[zlib.crc32(f"{'n' if k else 't'} {name}".encode()) % PATH] += 1.0 if depth < 3 else 0.7
        known = _PATHS[path] = np.minimum(known, 2.0)
    return known


def vectors(own: list[Block]) -> np.ndarray:
    """One row for each block: tag path, hashed words, and the text's shape."""
    out = np.zeros((len(own), PATH + WORDS + SHAPE), np.float32)
    for i, b in enumerate(own):
        out[i, :PATH] = path_vector(b.path)
        words = b.text.lower().split()
        hashed = np.bincount([zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORDS for w in words], minlength=WORDS)
        out[i, PATH : PATH + WORDS] = hashed / np.sqrt((hashed * hashed).sum())
        n = len(b.text)
        last = b.text[-1]
        out[i, PATH + WORDS :] = (
            min(1.0, np.log1p(n) / 8), min(1.0, b.linked / n), len(words) > 7, len(words) > 20, last in ".!?…:", i / len(own), b.text[0].isupper(), len(words) < 3
        )
    return out


@dataclass
class Labeller:
    """A bidirectional LSTM over the blocks of a page, and a logistic output for each block."""

    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def new(cls, seed: int = 1) -> Labeller:
        rng = np.random.default_rng(seed)
        d, h = PATH + WORDS + SHAPE, HIDDEN_UNITS
        p = {}
        for way in "fb":
            p[f"x{way}"] = rng.normal(0, 0.15, (d, 4 * h))
            p[f"h{way}"] = rng.normal(0, 0.15, (h, 4 * h))
            p[f"b{way}"] = np.r_[np.zeros(h), np.ones(h), np.zeros(2 * h)]  # open forget gates
        p["o"], p["ob"] = rng.normal(0, 0.2, 2 * h), np.zeros(1)
        return cls({k: v.astype(np.float32) for k, v in p.items()})

    def _run(self, x: np.ndarray, mask: np.ndarray, way: str, kept: list | None):
        h_n = HIDDEN_UNITS
        given = x @ self.p[f"x{way}"] + self.p[f"b{way}"]
        h = np.zeros((len(x), h_n), np.float32)
        c = np.zeros_like(h)
        out = np.zeros((*mask.shape, h_n), np.float32)
        steps = range(mask.shape[1]) if way == "f" else range(mask.shape[1] - 1, -1, -1)
        for t in steps:
            z = given[:, t] + h @ self.p[f"h{way}"]
            s = 1 / (1 + np.exp(-np.clip(z[:, : 3 * h_n], -30, 30)))
            i, f, o = s[:, :h_n], s[:, h_n : 2 * h_n], s[:, 2 * h_n :]
            g = np.tanh(z[:, 3 * h_n :])
            m = mask[:, t, None]
            new = f * c + i * g
            tc = np.tanh(new)
            if kept is not None:
                kept.append((t, h, c, i, f, o, g, tc))
            c = np.where(m, new, c)
            h = np.where(m, o * tc, h)
            out[:, t] = h
        return out

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, w, None) for w in "fb"], axis=2)
        return 1 / (1 + np.exp(-np.clip(both @ self.p["o"] + self.p["ob"], -30, 30)))

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
        kept: dict[str, list] = {"f": [], "b": []}
        outs = [self._run(x, mask, w, kept[w]) for w in "fb"]
        both = np.concatenate(outs, axis=2)
        gap = (1 / (1 + np.exp(-np.clip(both @ self.p["o"] + self.p["ob"], -30, 30))) - y) * mask / mask.sum()
        grad = {"o": np.einsum("bt,bth->h", gap, both), "ob": np.array([gap.sum()])}
        h_n = HIDDEN_UNITS
        for k, way in enumerate("fb"):
            to_h = gap[:, :, None] * self.p["o"][k * h_n : (k + 1) * h_n]
            dz_all = np.zeros((*mask.shape, 4 * h_n), np.float32)
            dh, dc, to_w = np.zeros((len(x), h_n)), np.zeros((len(x), h_n)), np.zeros_like(self.p[f"h{way}"])
            for t, h, c, i, f, o, g, tc in kept[way][::-1]:
                m = mask[:, t, None]
                own = dh + to_h[:, t]
                d_new = dc + own * o * (1 - tc * tc)
                dz = np.concatenate([d_new * g * i * (1 - i), d_new * c * f * (1 - f), own * tc * o * (1 - o), d_new * i * (1 - g * g)], axis=1) * m
                dz_all[:, t] = dz
                to_w += h.T @ dz
                dh = np.where(m, dz @ self.p[f"h{way}"].T, own)
                dc = np.where(m, d_new * f, dc)
            grad[f"h{way}"], grad[f"b{way}"] = to_w, dz_all.sum(axis=(0, 1))
            grad[f"x{way}"] = np.einsum("btd,btz->dz", x, dz_all)
        return grad

    def label(self, pages: list[np.ndarray], most: int = 8192) -> list[np.ndarray]:
        """Whether each block is main text; pages of like length run together."""
        out = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i, x in enumerate(pages) if len(x)), key=lambda i: len(pages[i]))
        while order:
            longest = len(pages[order[-1]])
            n = max(1, min(128, most // longest))
            some, order = order[-n:], order[:-n]
            x, mask = padded([pages[i] for i in some])
            p = self.probabilities(x, mask)
            for row, i in zip(p, some, strict=True):
                out[i] = row[: len(pages[i])] > 0.5
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, pages))
    x = np.zeros((len(pages), longest, pages[0].shape[1]), np.float32)
    mask = np.zeros((len(pages), longest), bool)
    for i, own in enumerate(pages):
        x[i, : len(own)], mask[i, : len(own)] = own, True
    return x, mask


def train(examples: list[tuple[np.ndarray, np.ndarray]], epochs: int = 8, rate: float = 0.01, seed: int = 1) -> Labeller:
    """Adam over batches of pages, by backpropagation through the whole page both ways."""
    model, rng = Labeller.new(seed), random.Random(seed)
    first = {k: np.zeros_like(v, np.float64) for k, v in model.p.items()}
    second = {k: np.zeros_like(v, np.float64) for k, v in model.p.items()}
    examples = [e for e in examples if len(e[0])]
    step = 0
    for epoch in range(epochs):
        rng.shuffle(examples)
        for at in range(0, len(examples), 16):
            some = examples[at : at + 16]
            x, mask = padded([e[0] for e in some])
            y = np.zeros(mask.shape, np.float32)
            for i, (_, own) in enumerate(some):
                y[i, : len(own)] = own
            step += 1
            for k, g in model.gradients(x, y, mask).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
                model.p[k] = (model.p[k] - rate * (0.3 if epoch >= epochs // 2 else 1) * move).astype(np.float32)
    return model


#: Names that tell blocks apart, for made pages and for the labels of the sample.
MAIN_NAMES = ["content", "post", "entry", "story", "article", "body", "main", "text"]
ASIDE_NAMES = [
    "ad", "ads", "advert", "advertisement", "banner", "sponsored", "promo", "sidebar", "widget", "related", "cookie", "notice", "consent", "alert", "popup", "modal",
    "newsletter", "subscribe", "comments", "comment", "reply", "menu", "nav", "navbar", "breadcrumb", "breadcrumbs", "share", "social", "footer", "header", "login", "search", "tags", "pagination",
]
ASIDE_TAGS = frozenset("nav footer aside form button select label menu dialog search".split())


def rule(own: Block) -> bool:
    """The label of a sampled page's block: in an article or main part, and in nothing beside it."""
    main = False
    for names in own.path:
        tag, *rest = names.split()
        if tag in ASIDE_TAGS or tag in ("header",) and not main or any(x in ASIDE_NAMES for x in rest):
            return False
        main = main or tag in ("article", "main") or any(x in MAIN_NAMES for x in rest)
    return main


def made_page(rng: random.Random) -> list[tuple[Block, bool]]:
    """A page of invented words with known labels."""
    sounds = ["ba", "en", "ti", "or", "qua", "lé", "st", "mi", "ü", "sho", "za", "ing"]
    word = lambda: "".join(rng.choice(sounds) for _ in range(rng.randint(1, 4)))

    def line(a: int, b: int, stop: bool = True) -> str:
        text = " ".join(word() for _ in range(rng.randint(a, b))).capitalize()
        return text + rng.choice([".", ".", "!", "?"]) * (stop and rng.random() < 0.8)

    wrap = ("html", "body", *(["div"] if rng.random() < 0.4 else []), *(["div wrapper"] if rng.random() < 0.2 else []))
    out: list[tuple[Block, bool]] = []

    def put(main: bool, *path: str, text: str, linked: bool = False):
        out.append((Block((*wrap, *path), text, len(text) if linked else 0), main))

    def menu(*path: str):
        for _ in range(rng.randint(2, 8)):
            put(False, *path, "ul", "li", "a", text=line(1, 2, False), linked=True)

    def aside(name: str):
        tag = rng.choice(["div", "aside", "section", "p", "ul"])
        for _ in range(rng.randint(1, 3)):
            inner = rng.choice([(), ("p",), ("div",), ("h3",), ("li",)])
            put(False, f"{tag} {name}", *inner, text=line(1, rng.choice([4, 12, 40])), linked=rng.random() < 0.3)

    def beside():
        kind = rng.random()
        if kind < 0.2:
            for _ in range(rng.randint(1, 3)):
                put(False, rng.choice(["form", "form search", "form login"]), rng.choice(["label", "p", "button", "div"]), text=line(1, 5))
        elif kind < 0.35:
            for _ in range(rng.randint(1, 4)):
                put(False, "aside", rng.choice(["p", "h2", "div", "li"]), text=line(1, 30))
        else:
            aside(rng.choice(ASIDE_NAMES))

    if rng.random() < 0.5:
        put(False, "header", *rng.choice([("h1",), ("p",), ("div",), ("a",)]), text=line(1, 6, False))
    if rng.random() < 0.8:
        menu(rng.choice(["nav", "nav", "div menu", "div nav", "header"]))
    for _ in range(rng.randint(0, 2)):
        beside()
    main = rng.choice(["article", "article", "main", "main", f"div {rng.choice(MAIN_NAMES)}", f"article {rng.choice(MAIN_NAMES)}", f"section {rng.choice(MAIN_NAMES)}"])
    parts = [main] if rng.random() < 0.7 else ["main", main] if main != "main" else ["main", "article"]
    if rng.random() < 0.9:
        put(True, *parts, *rng.choice([("h1",), ("h1",), ("header", "h1")]), text=line(2, 12, False))
    for _ in range(rng.randint(1, 12)):
        inner = rng.choices(
            [("p",), ("p", "b"), ("p", "b", "p"), ("h2",), ("ul", "li"), ("blockquote",), ("blockquote", "p"), ("table", "tr", "td"), ("figure", "figcaption"), ("pre",), ("div",), ("section", "p"), ()],
            [30, 2, 2, 4, 5, 2, 2, 2, 1, 1, 2, 2, 1],
        )[0]
        for _ in range(rng.randint(2, 5) if inner[:1] in (("ul",), ("table",)) else 1):
            put(True, *parts, *inner, text=line(1, rng.choice([3, 20, 60, 120])))
        if rng.random() < 0.08:
            put(False, *parts, f"div {rng.choice(ASIDE_NAMES)}", *rng.choice([(), ("p",)]), text=line(1, 25))
    for _ in range(rng.randint(0, 3)):
        beside()
    if rng.random() < 0.3:
        for _ in range(rng.randint(1, 5)):
            put(False, rng.choice(["section comments", "div comments", "ol comment"]), rng.choice(["p", "div comment", "li comment"]), text=line(2, 50))
    if rng.random() < 0.85:
        for _ in range(rng.randint(1, 3)):
            put(False, rng.choice(["footer", "footer", "div footer"]), *rng.choice([(), ("p",), ("ul", "li", "a")]), text=rng.choice(["© ", ""]) + line(1, 15))
    return out


def learn(sample: list[str], made: int = MADE_PAGES, seed: int = 1) -> Labeller:
    """Train on made pages, and on sampled ones labelled by ``rule`` where it finds main text."""
    rng = random.Random(seed)
    examples = []
    for _ in range(made):
        page = made_page(rng)
        examples.append((vectors([b for b, _ in page]), np.array([y for _, y in page], np.float32)))
    for page in sample:
        whole = blocks(page)
        labels = np.array([rule(b) for b in whole], np.float32)
        if labels.any():  # a long page is several examples, so that training keeps to short sequences
            for at in range(0, len(whole), TRAINED_BLOCKS):
                examples.append((vectors(whole[at : at + TRAINED_BLOCKS]), labels[at : at + TRAINED_BLOCKS]))
    return train(examples, seed=seed)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """``page_id, url, text, n_chars``: the blocks labelled main text, joined by spaces.

    A null or empty page has the empty text, as has one without main text. Whole pages are
    read. The labeller is trained on made pages and a bounded sample, chosen by a hash of
    the page; repeated rows get equal results, ids and urls pass through.
    """
    short = pages.where(F.char_length(F.col(html_col)).between(1, SAMPLE_CHARS)).select(F.xxhash64(html_col).alias("h"), F.col(html_col).alias("html"))
    # the smallest hashes first, so that no task sends more pages than are chosen from it
    least = [r.h for r in short.select("h").distinct().orderBy("h").limit(sample_pages).collect()]
    chosen = short.where(F.col("h") <= (least[-1] if least else 0)).groupBy("h").agg(F.min("html").alias("html")).collect()
    sample = [r.html for r in sorted(chosen, key=lambda r: r.h)]
    shared = pages.sparkSession.sparkContext.broadcast(learn(sample))

    def run(batches):
        for batch in small_batches(batches):
            own = [blocks(x or "") for x in batch.column(2).to_pylist()]
            chosen = shared.value.label([vectors(x) for x in own])
            texts = [" ".join(b.text for b, y in zip(x, ys, strict=True) if y) for x, ys in zip(own, chosen, strict=True)]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    chosen = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    return chosen.mapInArrow(run, "page_id long, url string, text string, n_chars long")
