"""Main text of web pages by a recurrent labeller of blocks.

A page becomes its sequence of leaf blocks.  A block's vector joins the sum of
learnt vectors of its path's hashed tokens (tags; words of class, id and role),
the mean of those of its hashed words, and a few measures.  A bidirectional
LSTM in numpy reads the whole sequence and says of every block whether it is
main text, so that a block is judged by what stands before and after it.

The model is trained here, at first use in a process, on ``TRAIN_PAGES`` pages
that a seeded generator builds with known labels (articles in many containers,
with menus, headers, footers, sidebars, notices, adverts, forms and comments
around and inside them); it takes some seconds on the driver, and its weights
(under a megabyte) go to the tasks.

Defined results: a null or empty page, or one without main text, gives an empty
text; white space, also of character references, becomes one space; text after
broken markup is kept (see ``html_blocks``); repeated rows are treated alike;
columns beyond those named are ignored by the query and kept by ``extract``.
"""

from __future__ import annotations

import html
import random
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsense.llm import _common
from colsense.llm.html_blocks import INLINE, Block, blocks

TRAIN_PAGES, EPOCHS, SEED = 700, 6, 11
PATHS, WORDS, PATH_SIZE, WORD_SIZE, HIDDEN, MEASURES = 2048, 2048, 16, 8, 24, 8


# Training pages

_MAIN = (("article", "article", "article", "main", "div", "section", "div"), ("article", "content", "post", "entry content", "article body", "story", "main content", "post content", "page content", "text", "body text", "prose", "main", "blog post"))
_NOISE = {
    "nav": (("nav", "nav", "div", "ul"), ("nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "tabs", "links", "main menu", "navigation")),
    "header": (("header", "header", "div"), ("header", "masthead", "site header", "branding", "top bar", "logo", "banner")),
    "footer": (("footer", "footer", "div"), ("footer", "site footer", "copyright", "legal", "colophon", "bottom", "contentinfo")),
    "aside": (("aside", "aside", "div", "section"), ("sidebar", "side", "widget", "related", "recommended", "more stories", "rail", "popular", "tags", "toc", "trending", "author bio", "complementary")),
    "notice": (("div", "section", "p", "dialog"), ("notice", "cookie", "cookie banner", "cookie notice", "consent", "gdpr", "alert", "banner", "popup", "modal", "newsletter", "paywall", "disclaimer", "message")),
    "ad": (("div", "ins", "aside", "section", "p", "div"), ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "promotion", "sponsor", "adsense", "ad slot")),
    "form": (("form", "form", "div"), ("form", "search", "subscribe", "login", "signup", "contact form", "comment form", "search form", "form")),
    "comments": (("div", "section", "ol", "ul"), ("comments", "comment list", "responses", "discussion", "replies", "reader comments", "user comments", "comment thread", "comment section", "comments area")),
    "share": (("div", "ul"), ("share", "social", "sharing", "share buttons", "social links")),
}
_SAID = {
    "nav": "home about contact news products login search blog archive help next previous page".split(),
    "header": "welcome official site daily weekly online".split(),
    "footer": "© copyright all rights reserved privacy terms imprint contact powered by".split(),
    "aside": "related popular read more see also tags latest trending follow".split(),
    "notice": "we use cookies accept consent privacy policy agree browser javascript enable subscribe newsletter".split(),
    "ad": "advertisement sponsored buy now sale offer discount shop".split(),
    "form": "email name password send submit search subscribe your message phone".split(),
    "comments": "reply says posted by comment ago wrote likes report".split(),
    "share": "share tweet facebook email print pin copy link".split(),
}
_LETTERS = ("abcdefghijklmnoprstuvw", "aeiouéèçlmnrstpdqu", "abdeghiklnorstuwzäöüß", "aeiolnrstdcmñóáí", "абвгдежзиклмнопрстуя")


class _Page:
    """A page under construction: its HTML and the expected (text, label) of its blocks."""

    def __init__(self, rng: random.Random):
        self.rng, self.out, self.expected = rng, [], []
        letters = rng.choice(_LETTERS)
        self.words = ["".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(150)]

    def sentence(self, low: int, high: int) -> str:
        words = self.rng.choices(self.words, k=self.rng.randint(low, high))
        if self.rng.random() < 0.1:
            words = [w + self.rng.choice(("&", "###", "%%%", "!!", "", "<", "|")) for w in words]
        return " ".join(words).capitalize() + self.rng.choice((".", ".", ".", "!", "?", "", ":"))

    def prose(self, most: int = 6) -> str:
        return " ".join(self.sentence(1, 22) for _ in range(self.rng.randint(1, most)))

    def named(self, names: str) -> str:
        if not names or self.rng.random() < 0.08:
            names = "".join(self.rng.choices("abcdefghijklmnopqrstuvwxyz", k=4))
        kind = self.rng.choice(("class", "class", "class", "id"))
        return f' {kind}="{self.rng.choice((" ", "-", "_")).join(names.split())}"'

    def block(self, tag: str, text: str, label: int, inner: str = "") -> None:
        shown = html.escape(text, quote=False)
        if self.rng.random() < 0.2 and " " in shown:
            a, _, b = shown.partition(" ")
            shown = self.rng.choice((f"<b>{a}</b> {b}", f"{a} <a href='#x'>{b}</a>", f"{a}&nbsp;{b}", f"{a}\n  {b}", f"<em>{a} {b}</em>"))
        attributes = self.named(self.rng.choice(("lead", "title", "text", "x"))) if self.rng.random() < 0.1 else ""
        end = "" if tag in ("p", "li") and self.rng.random() < 0.15 else f"</{tag}>"
        self.out.append(f"<{tag}{attributes}>{inner % shown if inner else shown}{end}")
        self.expected.append((" ".join(text.split()), label))

    def noise(self, kind: str) -> None:
        rng = self.rng
        tags, names = _NOISE[kind]
        tag = rng.choice(tags)
        plain = tag in ("nav", "header", "footer", "aside", "form")
        said = lambda: " ".join(rng.sample(_SAID[kind], rng.randint(1, 3)) + rng.choices(self.words, k=rng.randint(0, 3))).capitalize()
        attributes = "" if plain and rng.random() < 0.5 else self.named(rng.choice(names))
        self.out.append(f"<{tag}{attributes}>")
        if tag == "p":
            self.expected.append(((text := rng.choice((said(), self.sentence(3, 14)))), 0))
            self.out.append(html.escape(text, quote=False) + "</p>")
            return
        if kind in ("nav", "share", "aside") and rng.random() < 0.7:
            wrap = tag not in ("ul", "ol")
            if wrap and rng.random() < 0.4:
                self.block(rng.choice(("h2", "h3", "h4", "div")), said() if rng.random() < 0.6 else self.sentence(1, 4), 0)
            self.out.append("<ul>" * wrap)
            for _ in range(rng.randint(2, 7)):
                self.block("li", said() if rng.random() < 0.4 else self.sentence(1, 3), 0, "<a href='/a'>%s</a>")
            self.out.append("</li></ul>" if wrap else "")
        elif kind == "comments":
            if rng.random() < 0.5 and tag not in ("ol", "ul"):
                self.block(rng.choice(("h2", "h3", "h4", "p")), rng.choice((said(), f"{rng.randint(1, 99)} {said()}", self.sentence(1, 4))), 0)
            for _ in range(rng.randint(1, 5)):
                own = rng.choice(("li", "div", "article")) if tag not in ("ol", "ul") else "li"
                self.out.append(f"<{own}{self.named(rng.choice(('comment', 'comment body', 'reply', 'comment item')))}>")
                if rng.random() < 0.6:
                    self.block(rng.choice(("h4", "div", "p")), said() if rng.random() < 0.5 else self.sentence(1, 2), 0)
                self.block("p", self.prose(3), 0)
                self.out.append(f"</{own}>")
        elif kind == "form":
            for _ in range(rng.randint(1, 3)):
                self.block(rng.choice(("div", "p")), said(), 0, rng.choice(("<label>%s</label><input name='a'>", "<input type='text'>%s", "")))
            if rng.random() < 0.5:
                self.block("button", said(), 0)
        elif kind in ("ad", "notice", "footer", "header") and rng.random() < 0.5:
            text = rng.choice((said(), self.sentence(3, 14), "© " + self.sentence(1, 8)) if kind == "footer" else (said(), self.sentence(3, 14), self.sentence(3, 14)))
            self.expected.append((text, 0))
            self.out.append(html.escape(text, quote=False))
        else:
            for _ in range(rng.randint(1, 3)):
                self.block(rng.choice(("p", "div", "p", "h2", "h3", "h4")), rng.choice((said(), self.sentence(3, 16), self.prose(2))), 0)
        self.out.append(f"</{tag}>")

    def body(self, depth: int = 0) -> None:
        rng = self.rng
        if rng.random() < 0.2:  # many short paragraphs, or one again and again
            again = self.sentence(1, 3) if rng.random() < 0.5 else None
            for _ in range(rng.randint(3, 60)):
                self.block("p", again or self.sentence(1, 4), 1)
        for _ in range(rng.choice((1, 2, 3, 5, 8, 12))):
            kind = rng.random()
            if kind < 0.72:
                self.block("p", self.prose(), 1)
            elif kind < 0.80:
                self.block(rng.choice(("h2", "h3", "h4")), self.sentence(1, 8), 1)
            elif kind < 0.84:
                self.out.append("<ul>")
                for _ in range(rng.randint(1, 4)):
                    self.block("li", self.sentence(2, 12), 1)
                self.out.append("</ul>")
            elif kind < 0.87:
                self.block(rng.choice(("blockquote", "pre", "figcaption", "td", "dd")), self.sentence(3, 18), 1)
            elif kind < 0.90 and depth < 2:
                self.out.append(rng.choice(("<div>", "<section>", '<div class="row">')))
                self.body(depth + 1)
                self.out.append("</div></section>")
            elif kind < 0.97:
                self.noise(rng.choice(("ad", "share", "aside", "notice", "form", "nav", "ad")))

    def whole(self) -> None:
        rng = self.rng
        self.out.append("<!DOCTYPE html><html><head><title>A title</title><style>p{}</style><script>var t='<p>x</p>';</script></head><body>")
        wrap = rng.choice(("", "", "<div class='wrapper'>", "<div id='page'><div class='container'>"))
        self.out.append(wrap)
        for kind in rng.sample(("nav", "header", "notice", "ad", "nav", "form", "aside", "share"), rng.randint(0, 5)):
            self.noise(kind)
        if rng.random() > 0.06:
            tag = rng.choice(_MAIN[0])
            plain = tag in ("article", "main")
            self.out.append(f"<{tag}{'' if plain and rng.random() < 0.6 else self.named(rng.choice(_MAIN[1]))}>")
            if rng.random() < 0.8:
                self.block("h1", self.sentence(1, 10), 1)
            self.body()
            if rng.random() < 0.25:
                self.noise("comments")
            self.out.append(f"</{tag}>")
        for kind in rng.sample(("comments", "aside", "footer", "ad", "form", "nav", "footer", "share", "notice"), rng.randint(0, 5)):
            self.noise(kind)
        if rng.random() < 0.8:
            self.out.append("</body></html>")


def training_pages(n: int, seed: int = SEED) -> list[tuple[str, list[tuple[str, int]]]]:
    """Return ``n`` pages with the expected text and label of each block, made from ``seed``."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        page = _Page(rng)
        page.whole()
        out.append(("".join(page.out), page.expected))
    return out


# Vectors of blocks


@lru_cache(maxsize=20_000)
def _path_tokens(path: str) -> tuple[int, ...]:
    tokens = set()
    parts = [p.split() for p in path.split("/") if p]
    for tag, *names in parts:
        tokens.add("<" + tag)
        tokens.update("." + n for n in names)
    if leaf := next((tag for tag, *_ in reversed(parts) if tag not in INLINE), None):
        tokens.add("=" + leaf)
    return tuple(sorted(zlib.crc32(t.encode()) % PATHS for t in tokens))


class _Buckets(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        at = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % WORDS
        if len(word) < 32:
            self[word] = at
        return at


_BUCKETS = _Buckets()


def _measures(b: Block, words: list[str]) -> tuple[float, ...]:
    n = len(words)
    return (
        1.0, min(1.0, n / 50), min(1.0, np.log1p(n) / 5), b.linked, 1.0 if b.text[-1] in ".!?" else 0.0,
        min(1.0, len(b.text) / n / 12), 1.0 if n <= 3 else 0.0, min(1.0, sum(map(b.text.count, ".,;")) / n),
    )


class Vectors:
    """Bags of token numbers and measures of many blocks, in order."""

    @classmethod
    def joined(cls, parts: list["Vectors"]) -> "Vectors":
        out = cls([])
        for name in vars(out):
            setattr(out, name, np.concatenate([getattr(p, name) for p in parts]))
        return out

    def __init__(self, pages: list[list[Block]]):
        self.counts = np.array([len(p) for p in pages], int)
        paths, words, measures, n_paths, n_words = [], [], [], [], []
        for b in (b for p in pages for b in p):
            own, said = _path_tokens(b.path), b.text.split()
            paths.extend(own)
            n_paths.append(len(own))
            words.extend(map(_BUCKETS.__getitem__, said))
            n_words.append(len(said))
            measures.append(_measures(b, said))
        self.paths, self.words = np.array(paths, int), np.array(words, int)
        self.n_paths, self.n_words = np.array(n_paths, int), np.array(n_words, int)
        self.measures = np.array(measures, np.float32).reshape(-1, MEASURES)


def _bag(table: np.ndarray, tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.zeros((len(counts), table.shape[1]), np.float32)
    some = np.flatnonzero(counts)
    if len(some):
        out[some] = np.add.reduceat(table[tokens], (np.cumsum(counts) - counts)[some], axis=0)
    return out


# The network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """Bidirectional LSTM over blocks; ``w`` holds the weights by name."""

    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        size = PATH_SIZE + WORD_SIZE + MEASURES
        draw = lambda *shape, scale: (rng.normal(size=shape) * scale).astype(np.float32)
        self.w = {"path": draw(PATHS, PATH_SIZE, scale=0.1), "word": draw(WORDS, WORD_SIZE, scale=0.05), "out": draw(2 * HIDDEN, scale=0.1), "direct": draw(size, scale=0.1), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            self.w[d + "x"], self.w[d + "h"] = draw(size, 4 * HIDDEN, scale=0.15), draw(HIDDEN, 4 * HIDDEN, scale=0.15)
            self.w[d + "c"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)

    def inputs(self, v: Vectors) -> np.ndarray:
        words = _bag(self.w["word"], v.words, v.n_words) / np.maximum(v.n_words, 1)[:, None]
        return np.concatenate([_bag(self.w["path"], v.paths, v.n_paths), words.astype(np.float32), v.measures], axis=1)

    @staticmethod
    def _steps(counts: np.ndarray, back: bool) -> list[np.ndarray]:
        """Return, for each step, the blocks read then; pages with more blocks come first."""
        order = np.argsort(-counts, kind="stable")
        ends = np.cumsum(counts)[order]
        long = counts[order]
        most = int(long[0]) if len(long) else 0
        live = [int(np.searchsorted(-long, -t, side="left")) for t in range(most)]
        return [(ends[: live[t]] - 1 - t) if back else (ends[: live[t]] - long[: live[t]] + t) for t in range(most)]

    def _read(self, x: np.ndarray, counts: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        out = np.zeros((len(x), HIDDEN), np.float32)
        gates_x = x @ self.w[d + "x"] + self.w[d + "c"]
        h = c = np.zeros((len(counts), HIDDEN), np.float32)
        for at in self._steps(counts, d == "b"):
            h, c = h[: len(at)], c[: len(at)]
            g = gates_x[at] + h @ self.w[d + "h"]
            i, f, o = (_sigmoid(g[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in (0, 1, 2))
            u = np.tanh(g[:, 3 * HIDDEN :])
            new = f * c + i * u
            t = np.tanh(new)
            if keep is not None:
                keep.append((at, h, c, i, f, o, u, t))
            h, c = o * t, new
            out[at] = h
        return out

    def probabilities(self, v: Vectors) -> np.ndarray:
        if not len(v.measures):
            return np.zeros(0)
        x = self.inputs(v)
        both = np.concatenate([self._read(x, v.counts, "f"), self._read(x, v.counts, "b")], axis=1)
        return _sigmoid(both @ self.w["out"] + x @ self.w["direct"] + self.w["bias"])

    def gradients(self, v: Vectors, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        x = self.inputs(v)
        kept: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self._read(x, v.counts, d, kept[d]) for d in "fb"], axis=1)
        p = _sigmoid(both @ self.w["out"] + x @ self.w["direct"] + self.w["bias"])
        loss = -np.log(np.where(labels == 1, p, 1 - p) + 1e-9).mean()
        error = ((p - labels) / len(labels)).astype(np.float32)
        g = {"out": both.T @ error, "direct": x.T @ error, "bias": error.sum(keepdims=True)}
        dx = error[:, None] * self.w["direct"]
        dboth = error[:, None] * self.w["out"]
        for k, d in enumerate("fb"):
            dout = dboth[:, k * HIDDEN : (k + 1) * HIDDEN]
            dgates = np.zeros((len(x), 4 * HIDDEN), np.float32)
            g[d + "h"] = np.zeros_like(self.w[d + "h"])
            dh = dc = np.zeros((0, HIDDEN), np.float32)
            for at, h, c, i, f, o, u, t in reversed(kept[d]):
                n = len(at)
                dh, dc = (np.concatenate([z, np.zeros((n - len(z), HIDDEN), np.float32)]) for z in (dh, dc))
                dh = dh + dout[at]
                dc = dc + dh * o * (1 - t * t)
                step = np.concatenate([dc * u * i * (1 - i), dc * c * f * (1 - f), dh * t * o * (1 - o), dc * i * (1 - u * u)], axis=1)
                dgates[at] = step
                g[d + "h"] += h.T @ step
                dh, dc = step @ self.w[d + "h"].T, dc * f
            g[d + "x"], g[d + "c"] = x.T @ dgates, dgates.sum(axis=0)
            dx = dx + dgates @ self.w[d + "x"].T
        g["path"], g["word"] = np.zeros_like(self.w["path"]), np.zeros_like(self.w["word"])
        np.add.at(g["path"], v.paths, np.repeat(dx[:, :PATH_SIZE], v.n_paths, axis=0))
        np.add.at(g["word"], v.words, np.repeat(dx[:, PATH_SIZE : PATH_SIZE + WORD_SIZE] / np.maximum(v.n_words, 1)[:, None], v.n_words, axis=0))
        return float(loss), g


def fit(pages: list[tuple[str, list[tuple[str, int]]]], epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """Train a labeller by Adam on pages with labels."""
    model = Labeller(seed)
    first = {k: np.zeros_like(w) for k, w in model.w.items()}
    second = {k: np.zeros_like(w) for k, w in model.w.items()}
    rng, batch, k = np.random.default_rng(seed), 32, 0
    made = []
    for page, expected in pages:
        found = blocks(page)
        if [b.text for b in found] == [t for t, _ in expected] and found:  # the generator's odd nestings may merge blocks
            made.append((Vectors([found]), [label for _, label in expected]))
    for epoch in range(epochs):
        order = rng.permutation(len(made))
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        for at in range(0, len(order), batch):
            part = [made[i] for i in order[at : at + batch]]
            _, grads = model.gradients(Vectors.joined([p for p, _ in part]), np.array([x for _, own in part for x in own]))
            k += 1
            for name, g in grads.items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                model.w[name] -= (rate * (first[name] / (1 - 0.9**k)) / (np.sqrt(second[name] / (1 - 0.999**k)) + 1e-8)).astype(np.float32)
    return model


@lru_cache(maxsize=1)
def trained() -> Labeller:
    return fit(training_pages(TRAIN_PAGES))


def main_texts(model: Labeller, pages: list[str | None], group: int = 100) -> list[str]:
    """Return the main text of each page."""
    out = []
    for at in range(0, len(pages), group):
        found = [blocks(p) for p in pages[at : at + group]]
        good = model.probabilities(Vectors(found)) >= 0.5
        k = 0
        for own in found:
            out.append("\n\n".join(b.text for b, g in zip(own, good[k : k + len(own)]) if g))
            k += len(own)
    return out


def extract(pages: DataFrame, source: str = "html", name: str = "text") -> DataFrame:
    """Return ``pages`` with column ``name``, the main text of column ``source``; it replaces one of that name."""
    model = trained()

    @F.pandas_udf("string")
    def found(x):
        import pandas as pd

        return pd.Series(main_texts(model, [v if isinstance(v, str) else None for v in x]), dtype=object)

    _common.bound_batches(pages.sparkSession)
    kept = [c for c in pages.columns if c.lower() != name.lower()]
    return pages.withColumn("__main", found(F.col(source))).select(*kept, F.col("__main").alias(name))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of ``pages`` with its main text and the text's length in code points."""
    pages = _common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


