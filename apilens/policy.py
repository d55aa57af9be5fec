"""Fixed values of the scanner: literals, prefixes, extensions, markers, limits."""

from __future__ import annotations

# --- fixed values -----------------------------------------------------------
API_PREFIXES = ("/api", "/graphql", "/trpc")
API_CALLS = ("fetch(", "fetch (", "axios.get(", "axios.post(", "axios.put(", "axios.delete(", "axios.patch(", "ky.get(", "ky.post(", "ky.put(", "ky.delete(", "ky.patch(")
API_CANDIDATES = API_PREFIXES
ROUTE_CALLS = ("router.push(", "router.replace(", "router.prefetch(", "navigate(")
ROUTE_VALUES = ("href", "pathname", "asPath", "action", "formAction")
ROUTE_STARTS = ('"/', "'/", "`/", '\\"/', "\\'/")
BAD_EXT = (".js", ".mjs", ".css", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".woff", ".woff2", ".ttf", ".ico", ".webp", ".avif", ".mp4", ".webm", ".map", ".wasm")
ROUTE_BAD_EXT = (*BAD_EXT, ".json", ".txt", ".xml")
SOURCE_EXT = (".ts", ".tsx", ".jsx", ".vue", ".svelte", ".md", ".mdx", ".cjs", ".d.ts")
INTERNAL_STARTS = ("/ROOT/", "/home/", "/assets/app/", "/src/")
INTERNAL_CONTAINS = ("/node_modules/", "/.next/", "/.bun/", "/.git", "/.env", "/.staging", "/vercel/path", "/proc/", "/dev/")
INTERNAL_EXACT = ("/dev", "/proc", "/opfs", "/vfs", "/tmp", "/home", "/src")
DEV_ENDS = (".d.ts", ".config")
DEV_CONTAINS = ("/inferredProject", "/autoImportProviderProject", "/auxiliaryProject", "/*@__PURE__", "/*{dynamic}*", "/__delete", "/:ids+.", "/rmx:")
FRAMEWORK_STARTS = ("/_next", "/_nuxt", "/_app", "/_astro")

FIRST_ARG_CLIENTS = ("$fetch(", "useFetch(", "useLazyFetch(", "ofetch(", "useRequestFetch()(", "useNuxtApp().$fetch(", "nuxtApp.$fetch(", "ky(")
OBJECT_CLIENTS = ("axios(", "axios.request(")
CLIENT_VERBS = ("GET", "POST", "PUT", "PATCH", "DELETE")
FIRST_ARG_TEMPLATES = ("$api.${method}(", "$api.{method}(", "$axios.${method}(")
GENERIC_TEMPLATES = (".{method}(",)
RECEIVER_HINTS = ("api", "Api", "API", "axios", "http", "client", "Client", "service", "Service", "repo", "Repo", "request", "Request")

METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")  # bit i of the mask
NEAR_METHODS = ("DELETE", "PATCH", "POST", "PUT", "GET", "HEAD", "OPTIONS")  # in order of preference
CONTENT_TYPES = ("json", "form", "urlencoded", "text")  # bit i of the mask
BODY_HINTS = ("body", "formdata(")
HEADER_HINTS = ("headers", "content-type", "authorization")
AUTH_HINTS = ("authorization", "bearer")
CONTENT_HINTS = {"json": ("application/json",), "form": ("multipart/form-data", "formdata("), "urlencoded": ("application/x-www-form-urlencoded", "urlsearchparams("), "text": ("text/plain",)}

ASSET_LITERALS = (
    "/_next/static/", "/_nuxt/", "_nuxt/", "/__nuxt_island/", "pages/", "components/", "composables/", "plugins/", "/_app/immutable/", "_app/immutable/", "nodes/", "chunks/", "entry/", "/_astro/", "_astro/", "/_actions/", "/build/routes/", "build/routes/",
    "routes/", "/assets/routes/", "/assets/", "assets/", "/static/js/", "static/js/", "/static/chunks/", "static/chunks/", "/_next/data/", "?_rsc=", "&_rsc=", "?_data=", "&_data=", ".rsc", "_payload.json", "__data.json",
)
DATA_MARKERS = ("/_next/data/", "/_payload.json", "_payload.json", "/__data.json", "__data.json", "?_data=", "&_data=", "/_actions/")
CONTEXT_MARKERS = ("__next_f.push", "Next-Action", "next-action", "$ACTION_", "__NUXT_DATA__", "__sveltekit_", "astro-island", "__remixContext")
NEXT_CONTEXT = ("/_next/", "__NEXT_DATA__", "self.__next_f.push", "__next_f.push", "Next-Action", "next-action", "$ACTION_")
NUXT_CONTEXT = ("__NUXT_DATA__", "_payload.json", "/_nuxt/")
SVELTE_CONTEXT = ("__sveltekit_", "/__data.json", "/_app/immutable/", "/immutable/", "/_app/version.json", "__SVELTEKIT", "data-sveltekit", "x-sveltekit-action", "x-sveltekit-invalidated")
ASTRO_CONTEXT = ("astro-island", "/_actions/", "/_astro/", "astro:actions", "_actions/")
REMIX_CONTEXT = ("__remixContext", "__remixManifest", "remix-route", "/build/routes/")
ANGULAR_CONTEXT = ('ng-version="', "_nghost-", "_ngcontent-", "<app-root", "ng-app=", "@angular/core", "ɵɵdefineComponent", "ɵɵdefineNgModule", "platformBrowser")
NEXT_ACTION_MARKERS = ("Next-Action", "next-action", "$ACTION_")
NEXT_SKIP = (
    "framework-", "polyfills-", "webpack-", "main-app-", "_next/static/chunks/_turbopack_", "[turbopack]_runtime", "[next]_internal_", "react-refresh", "next/dist/", "instrumentation-", "app-pages-internals-", "app-client-internals-", "/_astro/hoisted.", "/build/_shared/",
)
NUXT_SKIP = ("/_nuxt/error-", "/_nuxt/entry.", "/_nuxt/node_modules/", "/_nuxt/@vite/", "/_nuxt/vendors", "/_nuxt/vendor", "/_nuxt/polyfills")
SVELTE_SKIP = ("/_app/immutable/chunks/scheduler.", "/_app/immutable/chunks/index.", "/_app/immutable/chunks/runtime.", "/_app/immutable/chunks/vendor")
ASTRO_SKIP = ("/_astro/hoisted.", "/_astro/polyfills", "/_astro/client.")
REMIX_SKIP = ("/build/_shared/", "/build/manifest-", "/assets/manifest-", "/entry.client-")
NUXT_PREFIXES = ("chunks/", "entry/", "pages/", "components/", "composables/", "plugins/")
SVELTE_PREFIXES = ("nodes/", "chunks/", "entry/", "assets/")
SVELTE_CHILDREN = ("/immutable/entry/", "/immutable/nodes/", "/immutable/chunks/", "/immutable/assets/")
NEXT_ARTIFACTS = ("_buildManifest.js", "_ssgManifest.js", "app-build-manifest.json", "_clientReferenceManifest.json")
LOW_SIGNAL = ("vendor", "vendors", "framework", "runtime", "webpack", "polyfill", "node_modules", "analytics")
ANGULAR_MAPS = ("APIs", "apis", "Apis", "endpoints", "Endpoints", "ENDPOINTS", "urls", "URLs", "routes")

MAX_ASSETS, MAX_LOW_SIGNAL, MAX_BODY = 2048, 64, 50 << 20
GREP_CONTEXT, GREP_HITS, GREP_BYTES = 2, 50, 200
FRESH_S, STALE_S, CHUNK_FRESH_S, CHUNK_STALE_S = 300, 3600, 86400, 30 * 86400
# ----------------------------------------------------------------------------

FRAMEWORKS = ("next", "nuxt", "sveltekit", "astro", "remix", "angular")
FRAMEWORK_NAMES = {"next": "Next.js", "nuxt": "Nuxt", "sveltekit": "SvelteKit", "astro": "Astro", "remix": "Remix", "angular": "Angular"}
CONTEXTS = {"next": NEXT_CONTEXT, "nuxt": NUXT_CONTEXT, "sveltekit": SVELTE_CONTEXT, "astro": ASTRO_CONTEXT, "remix": REMIX_CONTEXT, "angular": ANGULAR_CONTEXT}


def client_anchors() -> list[tuple[str, str | None, str]]:
    """(anchor, method, mode) of every client call form, in the order they are looked for."""
    out = [(a, None, "first_arg") for a in FIRST_ARG_CLIENTS] + [(a, None, "object") for a in OBJECT_CLIENTS]
    for templates, mode in ((FIRST_ARG_TEMPLATES, "first_arg"), (GENERIC_TEMPLATES, "generic_method")):
        out += [(t.replace("{method}", verb.lower()), verb, mode) for t in templates for verb in CLIENT_VERBS]
    return out
