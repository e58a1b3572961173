"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the document tree.

A leaf block is the text between two block-level tags.  Its features are its ancestors' tags, classes and ids and the
shape of its text; the chain's two labels are article text and everything else.  Weights are fitted on labelled pages
by the likelihood's gradient with a forward-backward pass over all pages at once; Viterbi decodes a page.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from farstray.llm.common import small_batches, tidy

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
PART = re.compile(r"[a-z]+")
#: Fixed values of HTML: inline elements don't end a block, void ones have no content, raw ones no markup.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img picture source math mi mn mo ms mtext mspace mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle semantics annotation".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template".split())
#: Their content is text or fallback text; the only ones that a slash may close at once.
EMBEDDED = frozenset("noscript iframe object svg canvas video audio".split())
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    linked: int


def leaf_blocks(page: str) -> list[Block]:
    """The page's non-empty leaf blocks in order; unclosed and cut-off markup is closed at the end."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    linked = links = at = 0

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                out.append(Block(joined, tuple(n for _, names in stack for n in names), linked))
            text.clear()
        linked = 0

    size = len(page)
    while at < size:
        found = TOKEN.search(page, at)
        begin = found.start() if found else size
        if begin > at:
            text.append(page[at:begin])
            linked += (begin - at) * (links > 0)
        if not found:
            break
        at = found.end()
        tag = (found.group(1) or "").lower()
        if not tag:
            continue
        closing = page[begin + 1] == "/"
        if tag in RAW and not closing:
            end = re.compile(rf"</{re.escape(tag)}(?![a-z0-9])", re.I).search(page, at)
            if not found.group(2).endswith("/") or tag in ("script", "style"):
                close = page.find(">", end.end()) if end else -1
                at = close + 1 if close >= 0 else size
            text.append(" ")
            continue
        if tag == "a":
            links = max(0, links - 1) if closing else 1
        if tag == "br":
            text.append(" ")
        if tag in INLINE or tag in VOID and tag != "hr":
            continue
        flush()
        links = 0
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag == "hr" or tag in EMBEDDED and found.group(2).endswith("/"):
            continue
        closes = CLOSES.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
        while stack and stack[-1][0] in closes:
            stack.pop()
        names = ["<" + tag]
        if "=" in found.group(2):
            for value in NAMES.findall(found.group(2)):
                names += ["." + p for p in PART.findall(value.lower())]
        stack.append((tag, tuple(names)))
    flush()
    return out


def features(blocks: list[Block]) -> list[list[str]]:
    rows = []
    for i, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        share = b.linked / max(1, len(b.text))
        row = list(dict.fromkeys(b.path))
        row += ["bias", f"words{min(6, words.bit_length())}", f"links{min(3, int(share * 4))}", "leaf" + (next((p for p in reversed(b.path) if p[0] == "<"), ""))]
        if b.text[-1:] in ".!?…:;\"'”»)":
            row.append("stop")
        if "©" in b.text or "(c)" in b.text.lower():
            row.append("copyright")
        if i == 0:
            row.append("first")
        if i == len(blocks) - 1:
            row.append("last")
        rows.append(row)
    return rows


@dataclass
class ChainModel:
    """Weights of "is article text" for features, of the four transitions, and of the first label."""

    weights: dict[str, float] = field(default_factory=dict)
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def decode(self, rows: list[list[str]]) -> list[int]:
        """The most likely labels (Viterbi)."""
        get, m = self.weights.get, self.moves.tolist()
        a, b, back = 0.0, 0.0, []
        for t, row in enumerate(rows):
            score = sum(get(f, 0.0) for f in row)
            if t:
                from0, from1 = a + m[0][0] >= b + m[1][0], a + m[0][1] >= b + m[1][1]
                back.append((0 if from0 else 1, 0 if from1 else 1))
                a, b = max(a + m[0][0], b + m[1][0]), max(a + m[0][1], b + m[1][1])
            b += score
        labels = [int(b > a)] if rows else []
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 250, rate: float = 0.1, ridge: float = 0.002) -> ChainModel:
    """Gradient steps (Adam) on the penalised log-likelihood of whole label chains."""
    names = {f: i for i, f in enumerate(dict.fromkeys(f for rows, _ in pages for row in rows for f in row))}
    n, longest = len(pages), max(len(r) for r, _ in pages)
    x = np.zeros((n, longest, len(names)))
    y, mask = np.zeros((n, longest), dtype=int), np.zeros((n, longest), dtype=bool)
    for p, (rows, labels) in enumerate(pages):
        for t, row in enumerate(rows):
            x[p, t, [names[f] for f in row]] = 1
            y[p, t], mask[p, t] = labels[t], True
    w, moves = np.zeros(len(names)), np.zeros((2, 2))
    seen = np.zeros((2, 2))
    both = mask[:, 1:]
    np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1)
    first, second = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for step in range(1, rounds + 1):
        emit = np.stack([np.zeros((n, longest)), x @ w], axis=2)
        ahead = np.zeros((n, longest, 2))
        ahead[:, 0] = emit[:, 0]
        for t in range(1, longest):
            new = np.logaddexp(ahead[:, t - 1, 0, None] + moves[0], ahead[:, t - 1, 1, None] + moves[1]) + emit[:, t]
            ahead[:, t] = np.where(mask[:, t, None], new, ahead[:, t - 1])
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        behind = np.zeros((n, longest, 2))
        pair = np.zeros((2, 2))
        for t in range(longest - 2, -1, -1):
            onward = behind[:, t + 1] + emit[:, t + 1]
            new = np.stack([np.logaddexp(moves[i, 0] + onward[:, 0], moves[i, 1] + onward[:, 1]) for i in (0, 1)], axis=1)
            behind[:, t] = np.where(mask[:, t + 1, None], new, 0)
            joint = np.exp(ahead[:, t, :, None] + moves[None] + onward[:, None, :] - total[:, None, None])
            pair += (joint * mask[:, t + 1, None, None]).sum(axis=0)
        chance = np.exp(ahead[..., 1] + behind[..., 1] - total[:, None])
        gradient = np.concatenate([((y - chance) * mask).reshape(-1) @ x.reshape(-1, len(names)) / n - ridge * w, ((seen - pair) / n - ridge * moves).reshape(-1)])
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        w, moves = w + move[:-4], moves + move[-4:].reshape(2, 2)
    return ChainModel({f: float(w[i]) for f, i in names.items()}, moves)


# --- labelled pages ---------------------------------------------------------------------------------------------------

_SYLLABLES = "ka lo mi ren sta tor ul ve za ni pel dor ish an ou é ñu schö ta".split()


def _prose(rng, least: int, most: int, stop: bool = True) -> str:
    words = ["".join(rng.choice(_SYLLABLES, size=rng.integers(1, 4))) for _ in range(rng.integers(least, most + 1))]
    return " ".join(words).capitalize() + ("." if stop else "")


def labelled_page(seed: int) -> tuple[str, str]:
    """A page built from parts whose role is known, and its main text."""
    rng = np.random.default_rng(seed)
    pick = lambda *options: options[rng.integers(len(options))]
    link = lambda: f'<a href="/{rng.integers(99)}">{_prose(rng, 1, 3, False)}</a>'
    menu = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.integers(2, 8))) + "</ul>"
    noise = {
        "menu": lambda: pick(f"<nav>{menu()}</nav>", f'<div class="menu">{menu()}</div>', f'<div id="nav" role="navigation">{menu()}</div>', f'<div class="breadcrumbs">{link()} / {link()}</div>'),
        "header": lambda: pick(f"<header><h2>{_prose(rng, 1, 4, False)}</h2><p>{_prose(rng, 2, 9)}</p></header>", f'<div class="header site-header">{_prose(rng, 2, 6, False)}</div>', f'<div id="banner" role="banner"><p>{_prose(rng, 2, 6)}</p></div>'),
        "footer": lambda: pick(f"<footer>&copy; {_prose(rng, 2, 5, False)} &middot; {_prose(rng, 3, 12)}</footer>", f'<div class="footer"><p>&copy; {_prose(rng, 3, 20)}</p></div>', f'<div id="footer" role="contentinfo">{link()} {_prose(rng, 3, 12)}</div>'),
        "side": lambda: pick(f"<aside><h3>{_prose(rng, 1, 4, False)}</h3><p>{_prose(rng, 5, 40)}</p>{menu()}</aside>", f'<div class="sidebar"><p>{_prose(rng, 5, 40)}</p></div>', f'<section class="related widget"><h4>{_prose(rng, 1, 3, False)}</h4>{menu()}</section>'),
        "notice": lambda: pick(f'<div class="cookie notice">{_prose(rng, 4, 30)}</div>', f'<div id="cookie-banner" class="consent"><p>{_prose(rng, 4, 30)}</p><button>OK</button></div>', f'<div role="alert" class="popup newsletter subscribe">{_prose(rng, 4, 20)}</div>'),
        "advert": lambda: pick(f'<div class="ad">{_prose(rng, 3, 30)}</div>', f'<div class="ads advert sponsored"><p>{_prose(rng, 3, 30)}</p></div>', f'<div id="promo" class="banner advertisement">{_prose(rng, 3, 20)}</div>'),
        "form": lambda: pick(f"<form><label>{_prose(rng, 1, 3, False)}</label><input name=q><button>{_prose(rng, 1, 2, False)}</button></form>", f'<form class="search"><p>{_prose(rng, 2, 12)}</p><select><option>{_prose(rng, 1, 2)}<option>{_prose(rng, 1, 2)}</select><textarea>{_prose(rng, 1, 4)}</textarea></form>'),
        "comments": lambda: pick(f'<section id="comments" class="comments"><h3>{_prose(rng, 1, 2)}</h3>' + "".join(f'<div class="comment"><p>{_prose(rng, 3, 60)}</p></div>' for _ in range(rng.integers(1, 4))) + "</section>", f'<ol class="comment-list replies"><li class="comment"><article class="comment"><p>{_prose(rng, 3, 50)}</p></article></ol>', f'<div class="discussion responses"><p>{_prose(rng, 3, 50)}</p></div>'),
        "share": lambda: f'<div class="share social">{link()} {link()}</div>',
    }
    some = lambda chance, *kinds: "".join(noise[k]() for k in kinds if rng.random() < chance)
    truth, body = [], []

    def add(tag: str, least: int, most: int, stop: bool = True) -> None:
        parts = [_prose(rng, least, most, stop) for _ in range(1 if rng.random() < 0.7 else 2)]
        if tag in ("ul", "ol"):
            body.append(f"<{tag}>" + "".join(f"<li>{p}</li>" for p in parts) + f"</{tag}>")
            truth.extend(parts)
        elif rng.random() < 0.3:
            body.append(f"<{tag}><b>{parts[0]}</b><br>{' '.join(parts[1:])}" + f"</{tag}>" * (tag != "p" or rng.random() < 0.7))
            truth.append(" ".join(parts))
        else:
            body.append(f"<{tag}>{' '.join(parts)} {link() if rng.random() < 0 else ''}</{tag}>")
            truth.append(" ".join(parts))

    add("h1", 2, 9, rng.random() < 0.3)
    for _ in range(rng.integers(1, 9)):
        add(pick("p", "p", "p", "p", "p", "h2", "blockquote", "ul", "pre", "div"), 1 if rng.random() < 0.2 else 5, 80)
        if rng.random() < 0.15:
            body.append(some(0.3, "advert", "side", "form", "share", "notice"))
    if rng.random() < 0.4:  # short last words
        add("p", 1, 4)
    inner = "".join(body)
    main = pick(f"<article>{inner}</article>", f"<article>{inner}{some(0.3, 'comments', 'share')}</article>", f"<main><article>{inner}</article></main>", f'<main id="content">{inner}</main>', f'<div class="post entry-content">{inner}</div>', f'<div id="content" class="article body"><section>{inner}</section></div>', f'<div class="story" itemprop="articleBody">{inner}</div>')
    head = f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{_prose(rng, 2, 6)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head>'
    page = head + "<body>" + some(0.6, "notice", "header", "menu", "advert", "form") + main + some(0.5, "comments", "side", "advert", "form", "footer") + "</body></html>"
    return page, " ".join(truth)


def labelled(n: int) -> list[tuple[list[list[str]], list[int]]]:
    """Blocks of up to ``n`` labelled pages; a block is article text if the page's truth goes on with it."""
    out = []
    for seed in range(n):
        page, truth = labelled_page(seed)
        blocks, at, labels = leaf_blocks(page), 0, []
        for b in blocks:
            hit = truth.startswith(b.text, at) and truth[at + len(b.text) : at + len(b.text) + 1] in ("", " ")
            labels.append(int(hit))
            at += (len(b.text) + 1) * hit
        if at < len(truth):  # a block outside the article began as the article does; such a page can't be labelled
            continue
        out.append((features(blocks), labels))
    return out


def main_text(page: str | None, model: ChainModel) -> str:
    blocks = leaf_blocks(page or "")
    labels = model.decode(features(blocks))
    return " ".join(b.text for b, label in zip(blocks, labels) if label)


@lru_cache(maxsize=4)
def trained(pages: int) -> ChainModel:
    """The model of so many generated pages; the same ones each time, so a session trains it once."""
    return train(labelled(pages))


def extract(pages: DataFrame, model: ChainModel | None = None, training_pages: int = 400) -> DataFrame:
    """page_id, url, text, n_chars of every page; null html is empty and gives an empty text.

    The model is trained once on the driver from ``training_pages`` generated labelled pages, and broadcast: its size is
    that of their vocabulary of tags and classes.  Repeated rows stay repeated; other columns are ignored.
    """
    small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model or trained(training_pages))
    taken = pages.select("page_id", "url", "html")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(page.as_py(), shared.value) for page in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return taken.mapInArrow(tidy(run), taken.select("page_id", "url").schema.add("text", T.StringType()).add("n_chars", T.LongType()))
