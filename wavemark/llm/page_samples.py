"""Labelled pages for training the extractor: generated page layouts, each leaf block known to be article or not."""

from __future__ import annotations

import html
import random

#: Names that authors of pages give to parts around the article, in English, German, French and Spanish.
AROUND = {
    "menu": "nav menu navbar navigation topnav links breadcrumb breadcrumbs tabs toc pagination pager navigationsleiste hauptmenue menue menuprincipal navegacion".split(),
    "header": "header masthead banner top brand site logo toolbar kopf kopfzeile kopfbereich entete bandeau cabecera encabezado".split(),
    "footer": "footer bottom copyright legal colophon imprint fuss fusszeile impressum piedpage pied mentions pie piepagina".split(),
    "side": "sidebar side aside widget rail secondary related recommended trending popular tags promo seitenleiste seitenspalte randspalte verwandt beliebt laterale barrelaterale colonne lateral barralateral columna relacionados".split(),
    "ad": "ad ads advert advertisement sponsored sponsor promo banner adsbox commercial werbung anzeige anzeigen reklame publicite pub annonce annonces publicidad anuncio anuncios patrocinado".split(),
    "notice": "cookie consent notice alert gdpr popup modal overlay newsletter subscribe paywall disclaimer warning hinweis meldung datenschutz bandeau avis avertissement aviso privacidad".split(),
    "share": "share social follow buttons toolbar meta byline teilen partager compartir".split(),
    "comments": "comments comment replies reply discussion respond disqus thread reader feedback kommentare kommentar diskussion antworten commentaires commentaire reponses reactions comentarios comentario opiniones respuestas".split(),
    "form": "search login signup form subscribe contact suche anmeldung kontakt formular recherche connexion formulaire buscar contacto formulario".split(),
}
WITHIN = "article content post entry story main body text page copy prose maincontent artikel inhalt beitrag contenu corps texte articulo contenido cuerpo noticia".split()


def page(seed: int) -> tuple[str, list[bool]]:
    """(html, whether each leaf block is article text)."""
    r = random.Random(seed)
    letters = r.choice(["etaoinshrdlu", "enisratdhulc", "eaosrnidlctu", "aeiouéèßñ stnr".replace(" ", "")])
    word = lambda: "".join(r.choice(letters) for _ in range(r.choice([1, 2, 3, 4, 5, 6, 7, 8, 11])))
    out, labels = [], []
    bare, messy = r.random() < 0.25, r.random() < 0.35

    def sentence(least: int = 3, most: int = 22) -> str:
        words = [word() for _ in range(r.randint(least, most))]
        if messy and r.random() < 0.5:
            words = [w + r.choice(["", "&&&", "***", "$$$", " |", "!!"]) for w in words]
        return (" ".join(words)).capitalize() + r.choice([".", ".", ".", "!", "?", ""])

    def put(tag: str, text: str, keep: bool, close: bool = True) -> None:
        inner = html.escape(text, quote=False)
        if keep and r.random() < 0.1:
            inner = r.choice(["<b>{}<br>", "<a href='/x'>{}</a>", "<em>{}</em>", "<span class=x>{}</span>"]).format(inner)
        out.append(f"<{tag}>{inner}" + (f"</{tag}>" if close and not (messy and r.random() < 0.3) else ""))
        labels.append(keep)

    def named(kind: str) -> str:
        if bare and r.random() < 0.6:
            return ""
        name = r.choice(AROUND[kind])
        name = r.choice([name, name, f"{name}-{r.choice(AROUND[kind])}", f"site-{name}", f"{name} box", f"{name}{r.randint(1, 9)}"])
        return f' {r.choice(["class", "class", "id"])}="{name}"'

    def links(n: int, keep: bool = False) -> None:
        out.append("<ul>")
        for _ in range(n):
            out.append(f'<li><a href="/{word()}">{word()}{" " + word() if r.random() < 0.3 else ""}</a></li>')
            labels.append(keep)
        out.append("</ul>")

    def around(kind: str) -> None:
        tag = {"menu": "nav", "header": "header", "footer": "footer", "side": "aside", "comments": "section", "form": "form"}.get(kind, "div")
        tag = tag if r.random() < 0.6 or bare else "div"
        out.append(f"<{tag}{named(kind) if tag == 'div' or r.random() < 0.5 else ''}>")
        if kind == "menu":
            links(r.randint(3, 12))
        elif kind == "header":
            put(r.choice(["h1", "div", "p", "h2"]), sentence(1, 5), False)
            if r.random() < 0.5:
                links(r.randint(2, 6))
        elif kind == "footer":
            put(r.choice(["p", "div"]), r.choice(["© ", "Copyright ", ""]) + word() + ".example.com · " + sentence(), False)
            if r.random() < 0.5:
                links(r.randint(2, 6))
        elif kind == "side":
            put(r.choice(["h3", "h4", "p"]), sentence(1, 4), False)
            links(r.randint(2, 8)) if r.random() < 0.6 else [put("p", sentence(), False) for _ in range(r.randint(1, 3))]
        elif kind == "comments":
            put(r.choice(["h3", "h2", "p"]), f"{r.randint(1, 40)} {word()}", False)
            list_, item = r.choice([("", "div"), ("", "div"), ("ol", "li"), ("ul", "li")])
            out.append(f"<{list_}{named(kind)}>" if list_ else "")
            for _ in range(r.randint(1, 6)):
                out.append(f"<{item}{named(kind) if item == 'div' or r.random() < 0.3 else ''}>")
                put("p", " ".join(sentence() for _ in range(r.randint(1, 4))), False)
                out.append(f"</{item}>")
            out.append(f"</{list_}>" if list_ else "")
        elif kind == "form":
            put("p", sentence(1, 5), False)
            out.append('<input type="text"><button>' + word() + "</button>")
        else:
            if r.random() < 0.5:
                out.append(sentence())
                labels.append(False)
            else:
                for _ in range(r.randint(1, 2)):
                    put("p", " ".join(sentence() for _ in range(r.randint(1, 3))), False)
        out.append(f"</{tag}>")

    def paragraph() -> str:
        if r.random() < 0.15:
            return sentence(1, 3)
        return " ".join(sentence() for _ in range(r.choice([1, 1, 2, 3, 5, 9])))

    def article() -> None:
        tag = r.choice(["article", "article", "main", "div", "section"])
        mark = "" if bare or tag == "article" and r.random() < 0.7 else f' {r.choice(["class", "id"])}="{r.choice(WITHIN)}{r.choice(["", "-body", "-content", " " + r.choice(WITHIN)])}"'
        out.append(f"<{tag}{mark}>")
        if r.random() < 0.85:
            put(r.choice(["h1", "h1", "h2"]), sentence(3, 12), True)
        if r.random() < 0.15:
            around("share")
        for _ in range(r.choice([1, 2, 4, 7, 12, 25])):
            kind = r.random()
            if kind < 0.78:
                put("p", paragraph(), True)
            elif kind < 0.84:
                put(r.choice(["h2", "h3"]), sentence(2, 8), True)
            elif kind < 0.88:
                put(r.choice(["blockquote", "pre", "figcaption"]), paragraph(), True)
            elif kind < 0.93:
                out.append("<ul>")
                for _ in range(r.randint(2, 5)):
                    put("li", sentence(), True)
                out.append("</ul>")
            elif kind < 0.96:
                out.append("<table><tr>")
                for _ in range(r.randint(2, 4)):
                    put("td", sentence(1, 6), True)
                out.append("</tr></table>")
            else:
                around(r.choice(["ad", "share", "side", "notice"]))
        if r.random() < 0.2:
            around("comments")
        out.append(f"</{tag}>")

    out.append('<!DOCTYPE html><html><head><meta charset="utf-8"><title>' + sentence() + "</title><style>p{margin:0}</style><script>var t='</p>';</script></head><body>")
    lone = r.random() < 0.12  # nothing stands before the article
    for kind in ("notice", "header", "menu", "form", "ad", "side"):
        if not lone and r.random() < (0.8 if kind in ("menu", "header") else 0.35):
            around(kind)
    wrap = r.random() < 0.4
    if wrap:
        out.append(f'<div{"" if bare else " id=" + r.choice(["wrapper", "page", "container", "main"])}>')
    if r.random() < 0.95:
        article()
    for kind in ("side", "ad", "comments", "form", "menu"):
        if r.random() < 0.3:
            around(kind)
    if wrap:
        out.append("</div>")
    if r.random() < 0.85:
        around("footer")
    out.append("</body></html>" if r.random() < 0.85 else "")
    return "".join(out), labels
