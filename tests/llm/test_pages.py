"""Pages in the manner of common site builders, written by hand and kept out of training: class names of layouts and states,
forms about a whole page, furniture whose words are in no list. Measured by shared words with the article's own text."""

from collections import Counter

import pytest

from foldspan.llm import html_content

P = (
    "The ferry had been late all week, and nobody on the quay could say why it was so.",
    "When the fog lifted at noon, the first of the boats came round the point under sail.",
    "Her brother kept the books of the yard, where three hulls stood waiting for their masts.",
    "In the evening the keeper lit the lamp and wrote the weather down, as he did every day.",
    "Das Schiff lag seit Tagen im Hafen, und niemand wusste, wann es wieder auslaufen würde.",
    "Le bateau attendait la marée, et les enfants regardaient depuis le mur du vieux port.",
)
NOTE = ("We use small files to keep this site going; by reading on you agree to that.", "Sign up and get our letter once a week, free of charge and without any tricks.", "Lovely piece, my uncle used to sail that very boat when I was small.", "Seven lamps that every house should have, and where to get them for less.")
MENU = "<ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/s>Sea</a></li></ul>"


def paragraphs(k, n=3):
    return [P[(k + j) % len(P)] for j in range(n)]


def body(k):
    return "".join(f"<p>{x}</p>" for x in paragraphs(k)), " ".join(paragraphs(k))


#: (name, page with {b} for the article's blocks, {n0} to {n3} for furniture, {m} for a menu; what the article has besides).
LAYOUTS = [
    ("body has-sidebar", "<body class='has-sidebar'><article>{b}</article><div id=sidebar><p>{n3}</p></div></body>", ""),
    ("right-sidebar", "<body class='single right-sidebar'><article>{b}</article></body>", ""),
    ("with-sidebar", "<div class='content with-sidebar'><article>{b}</article></div>", ""),
    ("comments-open", "<article class='post comments-open'>{b}</article>", ""),
    ("no-sidebar", "<body class='no-sidebar'><main>{b}</main></body>", ""),
    ("social-enabled", "<body class='social-enabled'><main>{b}</main></body>", ""),
    ("page form", "<body><form id=form1><div class=main>{b}</div></form></body>", ""),
    ("page form with head", "<body><form method=post id=aspnetForm action=x><div class=top>{m}</div><div id=ctl00_main class=article><h1>Quay</h1>{b}</div><div id=footer>&copy; us</div></form>", "Quay"),
    ("wordpress", "<body class='post-template-default single single-post postid-7 logged-in customize-support'><div id=page class='site'><header id=masthead class=site-header>{m}</header><div id=primary class='content-area'><main id=main class='site-main'><article id=post-7 class='post-7 post type-post status-publish format-standard hentry category-sea'><header class=entry-header><h1 class=entry-title>Quay</h1></header><div class=entry-content>{b}</div></article><div id=comments class=comments-area><ol class=comment-list><li class='comment even'><article class=comment-body><p>{n2}</p></article></li></ol></div></main></div><aside id=secondary class=widget-area><p>{n3}</p></aside></div>", "Quay"),
    ("drupal", "<body class='html not-front one-sidebar sidebar-first page-node'><div id=page><div id=header>{m}</div><div id=main-wrapper><div id=content class=column><div class='node node-article node-promoted'><div class='field field-name-body'>{b}</div></div></div><div id=sidebar-first class='column sidebar'><p>{n3}</p></div></div><div id=footer-wrapper><p>{n1}</p></div></div>", ""),
    ("blogger", "<div class='content-outer'><div class='main-outer'><div class='post-outer'><div class='post hentry'><h3 class='post-title'>Quay</h3><div class='post-body entry-content'>{b}</div></div><div class=comments id=comments><p>{n2}</p></div></div><div class='column-right-outer'><div class='widget BlogArchive'><p>{n3}</p></div></div></div></div>", "Quay"),
    ("cookie bar outside", "<div class=gdprbar><p>{n0}</p></div><article>{b}</article>", ""),
    ("consent window", "<main>{b}</main><div class='cookieconsent-window'><span>{n0}</span></div>", ""),
    ("usercomments", "<article>{b}<div class=usercomments><p>{n2}</p></div></article>", ""),
    ("feedback section", "<article>{b}</article><section id=feedback><p>{n2}</p><p>{n2}</p></section>", ""),
    ("taboola", "<article>{b}<div class='taboola outbrain'><p>{n3}</p></div></article>", ""),
    ("plain divs", "<div id=wrap><div id=nav>{m}</div><div id=text><h1>Quay</h1>{b}</div><div id=right class=sidebar><p>{n3}</p></div></div>", "Quay"),
    ("table page", "<table><tr><td class=leftnav>{m}</td><td class=main>{b}</td></tr></table>", ""),
    ("data attributes", "<article data-class='advert' data-id='comments'>{b}</article>", ""),
    ("unknown names", "<div class=xq1><div class=zz9>{m}</div><div class=xq2><h1>Quay</h1>{b}</div><div class=kk3><a href=a>One</a> <a href=b>Two</a></div></div>", "Quay"),
    ("newsletter inside", "<div class=article-body>{b}<div class=newsletterSignup><p>{n1}</p></div></div><footer><p>{n0}</p></footer>", ""),
    ("sidebar-left layout", "<div class='layout sidebar-left'><main role=main>{b}</main><aside><p>{n3}</p></aside></div>", ""),
]


def pages():
    for n, (name, page, extra) in enumerate(LAYOUTS):
        for k in range(3):
            blocks, text = body(n + k)
            yield f"{name}/{k}", page.format(b=blocks, m=MENU, **{f"n{j}": NOTE[(j + (k if j else 0)) % 4 if j > 3 else j] for j in range(4)}), f"{extra} {text}".strip()


def f1(got, want):
    a, b = Counter(got.split()), Counter(want.split())
    both = sum((a & b).values())
    return 2 * both / (sum(a.values()) + sum(b.values())) if both else 0.0


@pytest.fixture(scope="module")
def model():
    return html_content.fitted(html_content.tallied(map(html_content.parse, html_content.labelled())))


def test_articles_survive_the_names_of_layouts(model):
    """Over 60 pages: no empty text, word F1 of 0.95 on average, and all of the article on each page."""
    found = [(name, html_content.main_text(page, model), want) for name, page, want in pages()]
    assert len(found) >= 60
    short = [(name, round(f1(got, want), 2)) for name, got, want in found if f1(got, want) < 0.9]
    assert all(got for _, got, _ in found) and sum(f1(got, want) for _, got, want in found) / len(found) >= 0.95, short
    lost = [name for name, got, want in found if Counter(want.split()) - Counter(got.split())]
    assert not lost, lost


def test_names_that_tell_of_states():
    families = html_content.families
    assert families("has-sidebar") == families("comments-open") == families("social_enabled") == () and families("sidebar") == ("side",)
    assert families("userComments") == families("usercomments") == ("remark",) and families("gdprbar") == ("notice",)
    assert families("research-notes") == families("node-promoted") == () and families("post") == ("main",) and families("postcard") == () and families("address") == () and families("shadow") == ()
