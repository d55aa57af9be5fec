"""Golden cases of the byte kernels: own snippets for each feature."""

from __future__ import annotations

import pytest

from apilens import policy
from apilens.kernels import bytescan as B
from apilens.kernels import classify, frameworks, jsonwalk, urlx
from apilens.kernels.discover import scan_document
from apilens.kernels.endpoints import scan_endpoints
from apilens.operators.grep import grep_bytes, window
from apilens.sql import methods_csv


def flags(shape):
    out = [n for n, on in (("body", shape.has_body), ("headers", shape.has_headers)) if on]
    out += [c for i, c in enumerate(policy.CONTENT_TYPES) if shape.content_types >> i & 1]
    return ",".join(out + [n for n, on in (("auth", shape.auth), ("query", shape.query_params), ("next-action", shape.next_server_action)) if on])


def found(source, kind):
    return {r[0] for r in scan_endpoints(source.encode()).rows if r[1] == kind}


def test_policy_counts():
    assert len(policy.API_CALLS) + len(policy.API_CANDIDATES) + len(policy.ROUTE_CALLS) + len(policy.ROUTE_VALUES) + len(policy.ROUTE_STARTS) == 29
    assert len(policy.BAD_EXT) == 18 and len(policy.ROUTE_BAD_EXT) == 21 and len(policy.client_anchors()) == 30
    assert len(policy.ASSET_LITERALS) == 34 and len(policy.DATA_MARKERS) == 8 and len(policy.CONTEXT_MARKERS) == 8
    assert {m for m in policy.CONTEXT_MARKERS} <= {m for c in policy.CONTEXTS.values() for m in c}


@pytest.mark.parametrize("source, url, methods, marks", [
    ("fetch('/bills',{method:'POST',body:b,headers:{'Content-Type':'application/json'}})", "/bills", "POST", "body,headers,json"),
    ("fetch('/look?q=1&p=2',{method:'post',body:new URLSearchParams(x)})", "/look", "POST", "body,urlencoded,query"),
    ('fetch("/ping",{method:"HEAD"})', "/ping", "HEAD", ""),
    ("axios.post(`/rooms/${room.id}/photo`,{a:1})", "/rooms/{dynamic}/photo", "POST", "body,json"),
    ("ky.get(`/kinds?size=${n}`)", "/kinds", "GET", "query"),
    ("fetch ('/me',{headers:{Authorization:`Bearer ${t}`}})", "/me", "GET", "headers,auth"),
    ("fetch('/plain')", "/plain", "GET", ""),
    ("axios.put('/x1/y',data)", "/x1/y", "PUT", "body"),
])
def test_calls(source, url, methods, marks):
    rows = [r for r in scan_endpoints(source.encode()).rows if r[2] == "api_call"]
    assert [(r[0], methods_csv(r[4]), flags(r[4])) for r in rows] == [(url, methods, marks)]


@pytest.mark.parametrize("source, url, methods", [
    ("$fetch('/one/a')", "/one/a", "GET"),
    ("useFetch('/two/a',{method:'delete'});", "/two/a", "DELETE"),
    ("useRequestFetch()('/three/a')", "/three/a", "GET"),
    ("axios({url:'/four/a',method:'patch',data:d})", "/four/a", "PATCH"),
    ("axios.request({method:'put',url:base+'/five'});const base='/api/v2'", "/api/v2/five", "PUT"),
    ("const root='/api/v3',users=root+'/users';ky(`${users}/${id}`)", "/api/v3/users/{dynamic}", "GET"),
    ("$api.$post('/six/a')", "/six/a", "POST"),
    ("this.userService.delete('/seven/a')", "/seven/a", "DELETE"),
])
def test_clients(source, url, methods):
    assert (url, methods) in {(r[0], methods_csv(r[4])) for r in scan_endpoints(source.encode()).rows if r[2] == "api_client"}


def test_receiver_must_look_like_a_client():
    assert not found("cart.get('/shelf/a')", "api")


def test_unknown_names_stop_a_binding():
    assert not {u for u in found("$fetch(other+'/tail')", "api")}


def test_candidates_and_routes():
    source = """a="/api/x?z=1#f";b='https://h.example/graphql';c=["/trpc/y","/img/logo.png"];router.push("/team/board");d={href:"/about-us",pathname:'/shop/list'};e="/api/";f=`/${only}`"""
    assert {"/api/x", "https://h.example/graphql", "/trpc/y"} <= found(source, "candidate")
    routes = found(source, "route")
    assert {"/team/board", "/about-us", "/shop/list"} <= routes
    assert not {r for r in routes if "png" in r or r.startswith("/api") or r == "/{dynamic}"}


@pytest.mark.parametrize("noise", ["/a.wasm", "/x", "/12345", "//cdn.example/x", "/{dynamic}/{dynamic}", "/_next/static", "/node_modules/", "/x/node_modules/y", "/src/main", "/proc", "/types.d.ts", "/p/view.tsx", "/Zk3$abcDEF_12", "/a%3Cb", "/has space", "/home/user", "/app.config", "/data.json", "/api/thing"])
def test_noise_is_no_route(noise):
    assert not classify.is_client_route(noise)


@pytest.mark.parametrize("route", ["/", "/about", "/blog/[slug]", "/a-b", "/users/{dynamic}", "/docs/v2/intro"])
def test_routes(route):
    assert classify.is_client_route(route)


def test_strings_and_tokens():
    assert B.string_from(rb"a\"b${c}d", 0, 0x22, True) == 'a"b${c}d'
    assert B.string_from(b"a${f({x:1})}b`rest", 0, 0x60, True) == "a{dynamic}b"
    assert B.string_from(b"never closed", 0, 0x22, False) == "never closed"
    assert B.quote_end(b"never closed", 0, 0x22) is None
    assert B.bracket_end(b"{a:[1,(2)],b:'}'}x", 0) == 16 and B.bracket_end(b"{open", 0) is None
    assert B.token_from(b"/a/${x.y}/b, c", 0, True) == "/a/{dynamic}/b"
    assert B.asset_token(b"/x?_rsc=abc def", 0) == "/x?_rsc=abc"
    assert B.text_of(b"\xff") is None
    assert B.field(b'{"a":1,"path" : "/x"}', "path") == "/x" and B.field(b"path:n,path:'/y'", "path") is None


def test_json():
    assert list(jsonwalk.walk(b'{"a":{"b":["x",{"c":"y"}],"d":"z"}}')) == [("key", None, "a"), ("key", None, "b"), ("string", "b", "x"), ("key", None, "c"), ("string", "c", "y"), ("key", None, "d"), ("string", "d", "z")]
    assert ("string", "c", "y") in list(jsonwalk.walk(b'{"a":[{"c":"y"}]} trailing'))
    assert list(jsonwalk.walk(b'["\\ud83d\\ude00","\\ud83d"]')) == [("string", None, "😀")]
    assert jsonwalk.object_keys(b'{"pages":{"/a":[1],"/b":{}}}', "pages") == ["/a", "/b"]
    assert jsonwalk.object_keys(b'{"/a":1,"/b"') is None and jsonwalk.object_keys(b"[]") is None


@pytest.mark.parametrize("text, want", [
    ("HTTP://Ex.Example:80/a/./b/../c//d", "http://ex.example/a/c/d"), ("https://u:p@h.example:8443", "https://u:p@h.example:8443/"), ("https://[2001:DB8::1]:443/x?q#f", "https://[2001:db8::1]/x?q#f"), ("https://h.example/é", "https://h.example/%C3%A9"),
])
def test_parse(text, want):
    assert str(urlx.parse(text)) == want


@pytest.mark.parametrize("bad", ["nothing", "http://", "https://a b/", "http://h:99999/", "http://[::1"])
def test_bad_urls(bad):
    assert urlx.try_parse(bad) is None


@pytest.mark.parametrize("ref, want", [("x.js", "https://h.example/d/x.js"), ("../y", "https://h.example/y"), ("/z?q", "https://h.example/z?q"), ("//o.example/p", "https://o.example/p"), ("?n=1", "https://h.example/d/e?n=1"), ("#f", "https://h.example/d/e?m#f"), ("http://k.example", "http://k.example/")])
def test_join(ref, want):
    assert str(urlx.parse("https://h.example/d/e?m").join(ref)) == want


def assets(source, url="https://h.example/p/", kind="html", config=None):
    return {a[0]: a[1:] for a in scan_document(source.encode(), url, kind, config).assets}


def evidence(source, url="https://h.example/p/", kind="html", config=None):
    return {(r[0], r[1], r[2], r[3]) for r in scan_document(source.encode(), url, kind, config).findings.rows}


def test_html_assets():
    got = assets('<base href="/base/"><SCRIPT SRC=main.js></SCRIPT><link rel="x modulepreload" href="m.mjs"><link rel=stylesheet href=s.css><script>import("./dyn.js");new URL("w.js",u);import(name)</script>')
    assert got == {"https://h.example/base/main.js": ("script", "html_script"), "https://h.example/base/m.mjs": ("script", "html_preload"), "https://h.example/p/dyn.js": ("script", "dynamic_import"), "https://h.example/p/w.js": ("script", "new_url")}


def test_empty_scripts_and_false_assets():
    assert scan_document(b"var a=1;", "https://h.example/a.js", "script").findings.rows == []
    assert not assets("// chunks/app.js\nx = chunks/app.js", kind="script")


def test_next():
    page = '<script id="__NEXT_DATA__" type="application/json">{"buildId":"b9","basePath":"/shop","locales":["en","de"]}</script><script src="/_next/static/chunks/pages/x.js"></script><script src="/_next/static/chunks/webpack-1.js"></script>'
    found_ = scan_document(page.encode(), "https://h.example/shop/de/cart", "html")
    assert found_.site.label == "Next.js (build b9)" and found_.revision == "b9"
    urls = {a[0] for a in found_.assets}
    assert "https://h.example/_next/static/b9/_buildManifest.js" in urls and "https://h.example/_next/static/chunks/pages/x.js" in urls
    assert not any("webpack" in u for u in urls)
    cdn = assets(page.replace('"basePath"', '"assetPrefix":"https://cdn.example","basePath"'))
    assert "https://cdn.example/shop/_next/static/b9/app-build-manifest.json" in cdn
    assert ("/cart", "api", "server_action", None) in evidence(page + "$ACTION_1", "https://h.example/shop/de/cart")


def test_next_manifests():
    build = 'self.__BUILD_MANIFEST=(function(s){return{"/":[s],"/team/[id]":[s,"x.js"],nested:{"/no":1},"/_app":[s]}})(1)'
    assert {r[0] for r in evidence(build, "https://h.example/_next/static/b/_buildManifest.js", "manifest") if r[2] == "manifest"} == {"/", "/team/[id]"}
    app = '{"pages":{"/(grp)/shop/page":[],"/blog/[s]/route":[],"/@side/panel/layout":[]}}'
    assert {r[0] for r in evidence(app, "https://h.example/app-build-manifest.json", "manifest") if r[2] == "manifest"} == {"/shop", "/blog/[s]", "/panel"}
    workers = '{"x":1,"serverActions":{"h":{"workers":{"app/cart/page":1},"y":2}}}'
    assert ("/cart", "route", "manifest", None) in evidence(workers, "https://h.example/_clientReferenceManifest.json", "manifest")


@pytest.mark.parametrize("raw, want", [("/a/b", "/a/b"), ("/(g)/a", "/a"), ("/@s/a", "/a"), ("/x/(..)y", "/x/y"), ("/(...)z", "/z"), ("/(g)", "/")])
def test_app_routes(raw, want):
    assert frameworks.app_route(raw) == want


def test_flight():
    pad = ",".join(f'\\"k{i}\\":{i}' for i in range(1500))
    source = f'<script>self.__next_f.push([1,"2:[{{{pad},\\"href\\":\\"/far/away\\"}}]\\n3:{{\\"url\\":\\"/api/near\\"}}"])</script>'
    got = evidence(source)
    assert ("/far/away", "route", "flight", None) in got and ("/api/near", "candidate", "flight", None) in got


def test_nuxt():
    page = '<script>window.__NUXT_DATA__={app:{baseURL:"/in/",buildId:"abcd-1",cdnURL:"https://c.example"},public:{apiBase:"/api/v1"},endpoints:{a:"users/list",b:"images/x",c:"/api/own"},routePath:"/in/shop"}</script>'
    got = evidence(page)
    assert {("/api/v1/users/list", "api", "literal", "nuxt"), ("/api/own", "api", "literal", "nuxt"), ("/in/shop", "route", "manifest", "nuxt")} <= got
    assert not any("images" in r[0] for r in got)
    assert {"https://c.example/in/_nuxt/builds/meta/abcd-1.json", "https://h.example/in/_nuxt/builds/latest.json"} <= set(assets(page))
    assert ("/deep", "route", "manifest", "nuxt") in evidence('["x"]', "https://h.example/deep/_payload.json", "payload")


def test_sveltekit():
    page = '<div data-sveltekit><form action="?/save"></form><form action="/login"></form><script>r={pattern:/^\\/blog\\/([^/]+?)\\/comments\\/([^/]+?)\\/?$/,params:["slug","comment"]};import("/_app/immutable/nodes/1.js")</script>'
    got = evidence(page, "https://h.example/team")
    assert {("/blog/[slug]/comments/[comment]", "route", "manifest", "sveltekit"), ("/login", "api", "literal", "sveltekit"), ("/team", "api", "literal", "sveltekit")} <= got
    urls = assets(page, "https://h.example/team")
    assert "https://h.example/_app/version.json" in urls and "https://h.example/blog/[slug]/comments/[comment]/__data.json" in urls
    deps = evidence('{"dependencies":["/api/items?x=1","/graphql"]}', "https://h.example/a/__data.json", "payload")
    assert {("/api/items", "api", "literal", "sveltekit"), ("/graphql", "api", "literal", "sveltekit")} <= deps


def test_angular_astro_remix():
    got = evidence('<app-root></app-root><script>APIs={"a":"/sgs/v1/find","b":"/x.png"};other={"c":"/no/thing"}</script>')
    assert ("/sgs/v1/find", "api", "literal", "angular") in got and not any(r[0] == "/no/thing" and r[1] == "api" for r in got)
    assert ("/_actions/like", "api", "literal", "astro") in evidence('<astro-island component-url="/_astro/A.1.js"></astro-island>"/_actions/like"')
    assert "https://h.example/_astro/A.1.js" in assets('<astro-island component-url="/_astro/A.1.js" renderer-url="/_astro/client.2.js">')
    assert ("/shop", "route", "manifest", "remix") in evidence("{}", "https://h.example/shop?_data=routes", "payload")


def test_grep():
    data = "first\nsecond needle é needle\nthird\nfourth needle".encode()
    hits = grep_bytes(data, b"needle", 0, None)
    assert [(h[1], h[2], h[3]) for h in hits] == [(2, 8, "second needle é needle"), (2, 18, "second needle é needle"), (4, 8, "fourth needle")]
    wide = grep_bytes(b"x" * 500 + b"needle" + "é".encode() * 500, b"needle", 2, 60)
    assert wide[0][4] and wide[0][3].startswith("…") and wide[0][3].endswith("…") and "needle" in wide[0][3]
    assert window(b"a" * 100, 0, 100, 0, 80, 10) == (0, 10)
    assert grep_bytes(data, b"") == [] and grep_bytes(b"", b"x") == []


@pytest.mark.parametrize("text, route", [
    (r'pattern:/^\/blog\/([^/]+?)\/?$/,params:["slug"]', "/blog/[slug]"), (r'pattern:/^\/a(?:\/([^/]*(?:x(y))?))?\/b$/,names:["p","q"]', "/a/[p]/b"), (r"pattern:/^\/f\/([^/]+)\.json$/", "/f/[param].json"),
    (r"pattern:/^\/$/", None), ("pattern:/x/", None), (r"pattern:/^\/open\/(abc", "/open/[param]"), (r"pattern:/^\/one-two_3~4\/\d+/", "/one-two_3~4"),
])
def test_routes_of_patterns(text, route):
    assert frameworks._pattern_route(text.encode()) == route
