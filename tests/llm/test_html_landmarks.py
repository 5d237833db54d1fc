from logtide.llm import html_extraction as H

TREE = H.train()
LONG = "many words stand in this paragraph " * 8


def test_link_list_inside_content():
    links = "".join(f"<li><a href=x>Another story {k}</a></li>" for k in range(6))
    page = f"<main><h1>Title</h1><p>{LONG}</p><ul>{links}</ul><p>Short one.</p><p>With <a href=y>one link</a> in it.</p></main>"
    assert H.main_text(page, TREE).split("\n") == ["Title", LONG.strip(), "Short one.", "With one link in it."]


def test_article_beside_a_teaser_with_a_content_class():
    for name in ("story", "post", "content"):
        page = f'<div class="{name}"><p>Read this too</p></div><div><h1>Title</h1><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>'
        assert H.main_text(page, TREE).split("\n")[-3:] == [LONG.strip()] * 3
