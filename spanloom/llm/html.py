"""HTML extraction by a recurrent block labeller.

A page is cut into its leaf blocks in order: runs of text between block-level tags, each with its path of tags (and the words of their class,
id and role). A block becomes a vector: hashed path, hashed words, and a few numbers (length, links, punctuation, depth, place). A
bidirectional LSTM (numpy) reads the sequence of a whole page, so that each block is labelled with all of the page in view; blocks
labelled as article make up the text.

The model is trained here, on pages that ``sample_pages`` invents from a seed (PAGES of them: that is the bound of the sample), once per
process; weights go to the executors with the function. Scripts, styles, comments, titles, and the contents of <template> and <iframe> (which
no reader sees) are left out by the parser. What stands in a control of a form (CONTROLS), within prose too, is a block of its own, which the
model reads with the others, but which is never article; the prose around it stays one block. Menus, headers, footers, sidebars, notices,
adverts, other texts of forms and reader comments are the model's matter; text in <svg> and <noscript> is text like any other.

Defined results: a null or empty page has the text "" ; text outside any tag is a block; an unclosed tag ends where its parent does, an
unclosed comment, script, style or text area at the end of the page; a comment ends at ``-->`` or ``--!>``, and ``<!-->`` and ``<!--->`` are whole ones; ``/>``
ends a script, style, <iframe> or <template> only where no end tag of its own follows, and never a control; an unclosed control ends with the block around it; an unclosed title is text; ``<`` that begins no tag is text; white space of any kind becomes one
space; inline tags and <br> don't end a block; every block of the page is read, however long; repeated rows give equal results.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.core import lean, slices

_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))
    |<(?P<raw>script|style|iframe|template)(?=[\s/>])
      (?:(?:[^>"']++|"[^"]*"|'[^']*')*+(?<=/)>(?!(?:(?!<(?P=raw)[\s/>]).)*?</(?P=raw)[\s/>])|.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z))
    |<textarea(?=[\s/>])(?:[^>"']++|"[^"]*"|'[^']*')*+>(?P<area>.*?)(?:</textarea(?=[\s/>])[^>]*>|\Z)
    |<title(?=[\s>])[^>]*(?<!/)>[^<]*(?:<(?!/?[a-z])[^<]*)*</title\s*>
    |<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>"']++|"[^"]*"|'[^']*')*+)>
    |<(?P<end2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs2>[^>]*)>
    |<[!?][^>]*>""",
    re.S | re.I | re.X,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_PART = re.compile(r"[a-z]+")
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_ENDS_P = BLOCK - {"html", "body"}
_SELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

#: Elements whose text belongs to a form and not to the prose that it may stand in.
CONTROLS = frozenset("button datalist label legend meter optgroup option output progress select textarea".split())

_LOOSE = CONTROLS - {"button", "select"}

PATH, WORDS, NUMBERS = 256, 32, 8
WIDTH = PATH + WORDS + NUMBERS
HIDDEN = 24
PAGES, EPOCHS, SEED = 1500, 16, 11


def blocks(page: str | None) -> list[tuple[tuple[str, ...], str, int]]:
    """(path with the words of class, id and role, text, characters within links) of the leaf blocks."""
    out: list[tuple[tuple[str, ...], str, int]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    around: list[tuple[int, list[str], int, int]] = []  # blocks that a control stands in: depth, texts, links, place
    linked = depth_a = 0
    place = None  # where the block belongs that began before a control's
    page = page or ""

    def close() -> None:
        nonlocal linked, place
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            out.insert(len(out) if place is None else place, (tuple(x for _, names in stack for x in names), text, linked))
        parts.clear()
        linked, place = 0, None

    def enter(tag: str, attrs: str) -> None:
        nonlocal parts, linked, place
        around.append((len(stack), parts, linked, len(out) if place is None else place))
        parts, linked, place = [], 0, None
        stack.append((tag, named(tag, attrs)))

    def leave(depth: int) -> None:
        """Ends all elements from this depth on, controls among them, and takes up the blocks that these stood in."""
        nonlocal parts, linked, place
        while around and around[-1][0] >= depth:
            close()
            del stack[around[-1][0] :]
            _, parts, linked, place = around.pop()
            parts.append(" ")
        del stack[depth:]

    def innermost(tag: str) -> int | None:
        return next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
            if depth_a:
                linked += m.start() - at
        at = m.end()
        if m["area"] is not None:
            enter("textarea", "")
            parts.append(m["area"])
            leave(len(stack) - 1)
            continue
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag, ending, attrs = tag.lower(), (m["end"] or m["end2"]), m["attrs"] or m["attrs2"] or ""
        if tag == "a":
            depth_a = max(0, depth_a + (-1 if ending else 1))
        elif tag == "br":
            parts.append(" ")
        elif tag in CONTROLS:
            if not ending:
                enter(tag, attrs)
            elif (i := innermost(tag)) is not None:
                leave(i)
        elif tag in BLOCK:
            if ending:
                i = innermost(tag)
                if i is not None and around and around[-1][0] > i:
                    leave(next(a[0] for a in around if a[0] > i))
                close()
                depth_a = 0
                if i is not None:
                    del stack[i:]
                continue
            # a block that ends the one around a label ends the label
            loose = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] not in _LOOSE), -1)
            if around and -1 < loose < len(stack) - 1 and (stack[loose][0] == "p" and tag in _ENDS_P or stack[loose][0] in _SELF.get(tag, ())):
                leave(loose + 1)
            close()
            depth_a = 0
            if tag == "hr":
                continue
            if stack and stack[-1][0] == "p" and tag in _ENDS_P:
                stack.pop()
            if stack and stack[-1][0] in _SELF.get(tag, ()):
                stack.pop()
            stack.append((tag, named(tag, attrs)))
    if at < len(page):
        parts.append(page[at:])
    leave(around[0][0] if around else len(stack))
    close()
    return out


def named(tag: str, attrs: str) -> tuple[str, ...]:
    """A tag with the words of its class, id and role."""
    return (tag, *("." + w for found in _NAMES.findall(attrs) for w in _PART.findall("".join(found).lower())))


def article(page: list[tuple[tuple[str, ...], str, int]], flags: np.ndarray) -> str:
    """The text of the blocks with a flag; what stands in controls is none."""
    return "\n\n".join(text for (path, text, _), ok in zip(page, flags, strict=True) if ok and CONTROLS.isdisjoint(path))


@lru_cache(maxsize=1 << 16)
def _slot(name: str, size: int) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % size


def vectors(page: list[tuple[tuple[str, ...], str, int]]) -> np.ndarray:
    """A row of WIDTH numbers for each block."""
    x = np.zeros((len(page), WIDTH), np.float32)
    for i, (path, text, linked) in enumerate(page):
        for name in path:
            x[i, _slot(name, PATH)] = 1
        words = text.split(" ")
        slots = np.bincount([_slot(w.lower(), WORDS) for w in words], minlength=WORDS)
        x[i, PATH : PATH + WORDS] = np.sqrt(slots / len(words))
        n = len(text)
        x[i, PATH + WORDS :] = (
            np.log1p(n) / 8,
            min(1.0, linked / n),
            min(1.0, sum(map(text.count, ".,;!?")) / len(words)),
            text[-1] in ".!?",
            path[-1] in ("h1", "h2", "h3") if path else 0,
            len(path) / 10,
            i / max(1, len(page) - 1),
            min(1.0, len(page) / 50),
        )
    return x


# ---------------------------------------------------------------------------------------------------------------------
# the network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _scan(x: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """One direction over (time, batch, features); masked steps carry the state over."""
    steps, n, _ = x.shape
    h = c = np.zeros((n, HIDDEN), np.float32)
    pre = x @ w + b
    out, tape = np.zeros((steps, n, HIDDEN), np.float32), []
    for t in range(steps):
        z = pre[t] + h @ u
        s = _sigmoid(z[:, : 3 * HIDDEN])
        i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
        g = np.tanh(z[:, 3 * HIDDEN :])
        m = mask[t][:, None]
        c2 = f * c + i * g
        tc = np.tanh(c2)
        h2 = o * tc
        if keep:
            tape.append((h, c, i, f, o, g, tc, m))
        h, c = m * h2 + (1 - m) * h, m * c2 + (1 - m) * c
        out[t] = h
    return out, tape


def _unscan(x: np.ndarray, d_out: np.ndarray, tape: list, w: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of w, u, b."""
    dz_all = np.zeros((len(x), x.shape[1], 4 * HIDDEN), np.float32)
    du = np.zeros_like(u)
    dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
    for t in range(len(x) - 1, -1, -1):
        h, c, i, f, o, g, tc, m = tape[t]
        dh = dh + d_out[t]
        d2, e2 = m * dh, m * dc
        e2 = e2 + d2 * o * (1 - tc * tc)
        dz = np.concatenate([e2 * g * i * (1 - i), e2 * c * f * (1 - f), d2 * tc * o * (1 - o), e2 * i * (1 - g * g)], axis=1)
        dz_all[t] = dz
        du += h.T @ dz
        dh, dc = (1 - m) * dh + dz @ u.T, (1 - m) * dc + e2 * f
    flat = dz_all.reshape(-1, 4 * HIDDEN)
    return x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(axis=0)


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, pages))
    x, mask = np.zeros((steps, len(pages), WIDTH), np.float32), np.zeros((steps, len(pages)), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k], mask[: len(p), k] = p, 1
    return x, mask


class Labeller:
    """A bidirectional LSTM with a logistic output for each block."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        init = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p |= {"w" + d: init(WIDTH, 4 * HIDDEN), "u" + d: init(HIDDEN, 4 * HIDDEN), "b" + d: np.zeros(4 * HIDDEN, np.float32)}
            self.p["b" + d][HIDDEN : 2 * HIDDEN] = 1
        self.p |= {"v": init(2 * HIDDEN, 1), "s": init(WIDTH, 1) * 0.1, "a": np.zeros(1, np.float32)}

    def run(self, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple:
        p = self.p
        f, tf = _scan(x, mask, p["wf"], p["uf"], p["bf"], keep)
        b, tb = _scan(x[::-1], mask[::-1], p["wb"], p["ub"], p["bb"], keep)
        both = np.concatenate([f, b[::-1]], axis=2)
        return _sigmoid((both @ p["v"] + x @ p["s"] + p["a"])[:, :, 0]), both, tf, tb

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        prob, both, tf, tb = self.run(x, mask, True)
        d = ((prob - y) * mask / mask.sum())[:, :, None].astype(np.float32)
        g = {"v": both.reshape(-1, 2 * HIDDEN).T @ d.reshape(-1, 1), "s": x.reshape(-1, WIDTH).T @ d.reshape(-1, 1), "a": d.sum(axis=(0, 1))}
        db = d @ p["v"].T
        g["wf"], g["uf"], g["bf"] = _unscan(x, db[:, :, :HIDDEN], tf, p["wf"], p["uf"])
        g["wb"], g["ub"], g["bb"] = _unscan(x[::-1], db[::-1, :, HIDDEN:], tb, p["wb"], p["ub"])
        return g

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page, whether each of its blocks is article; pages of like length are run together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        i = 0
        while i < len(order):
            j = i + 1
            while j < len(order) and j - i < 256 and len(pages[order[j]]) * (j - i + 1) <= 8192:
                j += 1
            group = order[i:j]
            prob = self.run(*_padded([pages[k] for k in group]))[0]
            for col, k in enumerate(group):
                out[k] = prob[: len(pages[k]), col] > 0.5
            i = j
        return out


def train(pages: list[tuple[str, list[bool]]], epochs: int = EPOCHS, seed: int = SEED, rate: float = 0.01) -> Labeller:
    """Fits a labeller to pages with a label for each block (Adam, gradient clipping)."""
    model, r = Labeller(seed), np.random.default_rng(seed)
    data = [(vectors(blocks(p)), np.array(y, np.float32)) for p, y in pages]
    data = sorted((d for d in data if len(d[1])), key=lambda d: len(d[1]))
    groups = [data[i : i + 24] for i in range(0, len(data), 24)]
    m1, m2, t = ({k: np.zeros_like(v) for k, v in model.p.items()} for _ in range(2)), None, 0
    m1, m2 = m1
    for epoch in range(epochs):
        step = rate * (0.5 ** (3 * epoch / epochs))
        for g in r.permutation(len(groups)):
            x, mask = _padded([d[0] for d in groups[g]])
            y = np.zeros(mask.shape, np.float32)
            for k, d in enumerate(groups[g]):
                y[: len(d[1]), k] = d[1]
            grad = model.gradients(x, mask, y)
            norm = np.sqrt(sum(float((v * v).sum()) for v in grad.values()))
            t += 1
            for k, v in grad.items():
                v = v * min(1.0, 1.0 / (norm + 1e-9))
                m1[k] = 0.9 * m1[k] + 0.1 * v
                m2[k] = 0.99 * m2[k] + 0.01 * v * v
                model.p[k] = (model.p[k] - step * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
    return model


# ---------------------------------------------------------------------------------------------------------------------
# invented pages


def sample_pages(n: int, seed: int = SEED) -> list[tuple[str, list[bool]]]:
    """Pages of many layouts with a label per block: article tags, main, or bare divs; menus, banners, adverts, sidebars, notices, forms, related
    links, reader comments and footers around and between."""
    r = random.Random(seed)
    syllables = "an the er on in ed st re ion que de la ich und ver os ado ci ñ é ü ra ment tion ou ai le".split()
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 4)))
    label = lambda: " ".join(word() for _ in range(r.randint(1, 3)))

    def sentence() -> str:
        odd = r.random()
        mark = r.choice(["!!", "***", "&amp;&amp;"]) if odd < 0.08 else ""
        text = " ".join(word() + mark for _ in range(r.randint(1, 22)))
        return (text.upper() if r.random() < 0.05 else text.capitalize()) + r.choice([".", ".", ".", "!", "?", ""])

    prose = lambda: " ".join(sentence() for _ in range(r.choice([1, 1, 1, 2, 3, 5, 8])))
    attr = lambda *names: r.choice([f' class="{x}"' for x in names] + [f' id="{x}"' for x in names])
    links = lambda k: "".join(f'<li><a href="/{word()}">{label()}</a></li>' for _ in range(k))

    def menu() -> str:
        body = f"<ul>{links(r.randint(1, 12))}</ul>"
        return r.choice([f"<nav>{body}</nav>", f"<nav{attr('menu', 'main-nav', 'topbar')}>{body}</nav>", f"<div{attr('menu', 'navbar', 'nav', 'navigation', 'breadcrumb')}>{body}</div>", f"<ul{attr('menu', 'nav')}>{links(r.randint(2, 8))}</ul>"])

    def banner() -> str:
        return r.choice([f"<header><h1>{label()}</h1><p>{sentence()}</p></header>", f"<header{attr('site-header', 'masthead')}><a href='/'>{label()}</a></header>", f"<div{attr('header', 'masthead', 'banner')}><p>{label()}</p></div>"])

    def advert() -> str:
        return f"<div{attr('ad', 'ads', 'advert', 'sponsored', 'promo', 'banner-ad')}>{r.choice([prose(), sentence(), f'<p>{prose()}</p>', f'<a href=x>{sentence()}</a>'])}</div>"

    def aside() -> str:
        inner = "".join(r.choice([f"<p>{prose()}</p>", f"<h3>{label()}</h3><ul>{links(4)}</ul>"]) for _ in range(r.randint(1, 4)))
        return r.choice([f"<aside>{inner}</aside>", f"<aside{attr('sidebar', 'related')}>{inner}</aside>", f"<div{attr('sidebar', 'related', 'widget', 'side')}>{inner}</div>"])

    def notice() -> str:
        return f"<div{attr('cookie', 'cookie-notice', 'consent', 'notice', 'alert', 'gdpr', 'popup', 'newsletter')}>{r.choice(['<p>' + prose() + '</p>', sentence()])}<button>{label()}</button></div>"

    def form() -> str:
        return f"<form{r.choice(['', attr('search', 'login', 'subscribe')])}><label>{label()}</label><input type=text><p>{sentence()}</p><button>{label()}</button></form>"

    def remarks() -> str:
        one = lambda: f"<div{attr('comment', 'reply')}><p>{prose()}</p></div>" if r.random() < 0.6 else f"<li{attr('comment')}><p>{label()}</p><p>{prose()}</p></li>"
        return f"<{(t := r.choice(['section', 'div', 'ol']))}{attr('comments', 'comment-list', 'discussion', 'responses')}><h3>{label()}</h3>{''.join(one() for _ in range(r.randint(1, 6)))}</{t}>"

    def footer() -> str:
        inner = r.choice([f"&copy; {word()}.example.com &middot; {prose()}", f"<p>{prose()}</p>", f"<ul>{links(4)}</ul><p>&copy; {sentence()}</p>"])
        return r.choice([f"<footer>{inner}</footer>", f"<footer>{inner}</footer>", f"<div{attr('footer', 'site-footer', 'copyright')}>{inner}</div>"])

    def control() -> str:
        return r.choice([f"<button>{label()}</button>", f"<select><option>{label()}</option><option>{label()}</option></select>", f"<textarea>{sentence()}</textarea>", f"<label>{label()}</label><input>", f"<button{attr('share', 'print')}><span>{label()}</span></button>"])

    def body() -> list[tuple[str, bool]]:
        out = [(f"<h{r.randint(1, 2)}>{sentence()}</h1>", True)] if r.random() < 0.8 else []
        for _ in range(r.choice([0, 1, 1, 2, 3, 4, 6, 10, 20, 40])):
            kind = r.random()
            if kind < 0.67:
                out.append((f"<p>{prose()}</p>", True))
            elif kind < 0.7:
                out.append((f"<p>{sentence()} {control()} {prose()}</p>", True))
            elif kind < 0.72:
                out.append((f"<div>{control()}</div>", False))
            elif kind < 0.8:
                out.append((f"<p><b>{prose()}<br>", True))
            elif kind < 0.86:
                out.append((f"<h{r.randint(2, 4)}>{label()}</h2>", True))
            elif kind < 0.9:
                out.append((f"<ul>{''.join(f'<li>{sentence()}</li>' for _ in range(r.randint(1, 5)))}</ul>", True))
            elif kind < 0.93:
                out.append((f"<blockquote>{prose()}</blockquote>", True))
            elif kind < 0.95:
                out.append((f"<table><tr><td>{label()}</td><td>{sentence()}</td></tr></table>", True))
            else:
                out.append((r.choice([advert, notice, aside, form])(), False))
        return out or [(f"<p>{prose()}</p>", True)]

    made = []
    for _ in range(n):
        top = [(f(), False) for f in (banner, menu, notice, advert, form) if r.random() < (0.75 if f is menu else 0.35)]
        low = [(f(), False) for f in (aside, remarks, advert, notice, footer) if r.random() < (0.8 if f is footer else 0.3)]
        r.shuffle(top)
        kind = r.random()
        if kind < 0.5:
            wrap = ("<article>", "</article>") if kind < 0.33 else (f"<article{attr('post', 'entry')}>", "</article>")
        elif kind < 0.72:
            wrap = ("<main>", "</main>")
        elif kind < 0.95:
            wrap = (f"<div{attr('content', 'post', 'article', 'entry', 'story', 'body', 'text', 'main')}>", "</div>")
        else:
            wrap = ("<div>", "</div>")
        head = f"<!DOCTYPE html><html><head><title>{label()}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>"
        chunks = [(head, False), *top, (wrap[0], True), *body(), (wrap[1], True), *low, (r.choice(["</body></html>", ""]), False)]
        page, edges = "", []
        for text, good in chunks:
            page += text
            edges.append((len(blocks(page)), good))
        flags: list[bool] = []
        for count, good in edges:
            flags += [good] * (count - len(flags))
        found = blocks(page)
        made.append((page, [f and CONTROLS.isdisjoint(b[0]) for f, b in zip(flags, found, strict=False)]))
    return made


@lru_cache(maxsize=2)
def trained(pages: int = PAGES, seed: int = SEED) -> Labeller:
    return train(sample_pages(pages, seed), seed=seed)


# ---------------------------------------------------------------------------------------------------------------------


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", model: Labeller | None = None) -> DataFrame:
    """(key, url, text, n_chars) for every page."""
    src = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(html).alias("html"))
    model = model or trained()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", 2 << 20):
                cut = [blocks(x) for x in part.column(2).to_pylist()]
                flags = model.label([vectors(b) for b in cut])
                texts = list(map(article, cut, flags))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[key, url, "text", "n_chars"])

    return src.mapInArrow(run, f"`{key}` {src.schema['k'].dataType.simpleString()}, `{url}` {src.schema['u'].dataType.simpleString()}, text string, n_chars bigint")


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
