"""Names of roles don't take a page's text away."""

import pytest

pytest.importorskip("quarryline.llm")
from quarryline.llm import style_tree  # noqa: E402

STORY = "A story of some length that is told here"


@pytest.mark.parametrize(
    "html",
    [
        f"<body><h1 class='main-title'>Title</h1><p>{STORY}</p></body>",
        f"<body class='has-sidebar'><h1>Title</h1><p>{STORY}</p><div class='sidebar'>no</div></body>",
        f"<article class='post comments-open'><h1>Title</h1><p>{STORY}</p><div class='comments'>no</div></article>",
        f"<body><form id='all'><h1>Title</h1><p>{STORY}</p><nav>no</nav></form></body>",
        f"<body class='sidebar'><h1>Title</h1><p>{STORY}</p><div class='site-footer'>no</div></body>",
        f"<article><h1>Title</h1><p>{STORY}</p><div class='reader-comments'>no</div><ul class='related-posts'><li>no</ul><div id='cookie-box'>no</div></article>",
        f"<body class='no-sidebar nav-open'><h1>Title</h1><p>{STORY}</p><div class='ad-slot'>no</div><p class='share-buttons'>no</p></body>",
        f"<h1>Title</h1><svg width='1'/><iframe src='x' /><p>{STORY}</p><svg><text>no</text></svg>",
    ],
)
def test_text_stays(html):
    assert style_tree.Page(html).text({}, 0.3) == f"Title\n\n{STORY}"


@pytest.mark.parametrize(
    "html",
    [
        "<nav><a href='/'>Home</a> <a href='/b'>Shop</a></nav>",
        "<body><nav>Home</nav><footer>All ours</footer></body>",
        "<div class='cookie-notice'><p>We use cookies on all of our pages.</p></div>",
        "<form><label>Name</label><input name='n'><p>Send it</p></form>",
        "<nav>Home and more</nav><article></article>",
        "<header><h1>The site</h1></header><div id='sidebar'><h1>Links</h1></div>",
        "<html><head><title>T</title></head><body><script>var a</script></body></html>",
        "<div hidden><p>Not shown</p></div><p style='color:red; display : none'>Nor this</p><p class='x' style=\"visibility:hidden\">Nor that</p>",
        "",
    ],
)
def test_nothing_but_other_things(html):
    assert style_tree.Page(html).text({}, 0.3) == ""


def test_roles_count_however_long():
    """Comments longer than the article, and a menu longer than the text, go."""
    many = "".join(f"<p>Sentence {k} of a reader who writes a lot.</p>" for k in range(80))
    assert style_tree.Page(f"<article><h1>Title</h1><p>{STORY}</p><section class='comments'>{many}</section></article>").text({}, 0.3) == f"Title\n\n{STORY}"
    assert style_tree.Page(f"<nav><ul>{many.replace('p>', 'li>')}</ul></nav><div><p>{STORY}</p></div>").text({}, 0.3) == STORY
    assert style_tree.Page(f"<div class='comments'>{many}</div><p>{STORY}</p>").text({}, 0.3) == STORY


def test_names_of_attributes_are_whole():
    """Values that speak of hiding, and names that only begin so, hide nothing."""
    html = f"<p title='hidden'>{STORY}</p><p data-hidden='1' aria-hidden='false'>B</p><p class='display:none'>C</p>"
    assert style_tree.Page(html).text({}, 0.3) == f"{STORY}\n\nB\n\nC"


def test_articles_in_other_things():
    """Cards in a sidebar and readers' comments are articles too; a lone article in a role is the text."""
    card = "<article><h3>Other</h3><p>Card</p></article>"
    assert style_tree.Page(f"<main><p>{STORY}</p><aside>{card}</aside><section class='comments'>{card}</section></main>").text({}, 0.3) == STORY
    assert style_tree.Page(f"<nav>no</nav><div class='widget'><article><p>{STORY}</p></article></div>").text({}, 0.3) == STORY
