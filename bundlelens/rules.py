"""Rules as data: the fixed values by which pages, scripts and strings are recognised.

All patterns keep to what Java's regular expressions and RE2 read alike. They become small DataFrames that are
broadcast; their sizes are those of the tables in this file.
"""

from __future__ import annotations

# Request headers of the emulated browser.
CHROME_MAJOR = "140"
USER_AGENT = f"Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/{CHROME_MAJOR}.0.0.0 Safari/537.36"
SEC_CH_UA = f'"Chromium";v="{CHROME_MAJOR}", "Not=A?Brand";v="24", "Google Chrome";v="{CHROME_MAJOR}"'
PLATFORM = '"Windows"'
ACCEPT_LANGUAGE = "en-US,en;q=0.9"
ACCEPT_ENCODING = "gzip, deflate, br"

# Type, accept, fetch mode, destination, priority.
RESOURCE_TYPES = [
    ("document", "text/html,application/xhtml+xml,application/xml;q=0.9,image/avif,image/webp,image/apng,*/*;q=0.8,application/signed-exchange;v=b3;q=0.7", "navigate", "document", "u=0, i"),
    ("script", "*/*", "no-cors", "script", "u=1"),
    ("module", "*/*", "cors", "script", "u=1"),
    ("style", "text/css,*/*;q=0.1", "no-cors", "style", "u=0"),
    ("manifest", "*/*", "cors", "manifest", "u=4"),
    ("worker", "*/*", "same-origin", "worker", "u=1"),
    ("sourcemap", "*/*", "cors", "empty", "u=4"),
    ("fetch", "*/*", "cors", "empty", "u=1, i"),
    ("other", "*/*", "no-cors", "empty", "u=4"),
]
RESOURCE_SCHEMA = "type string, accept string, mode string, dest string, priority string"

# Statuses worth another try, hops of redirects, limits of the crawl.
RETRYABLE = [408, 425, 429, 500, 502, 503, 504]
MAX_REDIRECTS, MAX_ROUNDS, SITEMAP_FILES, SITEMAP_PAGES, MIN_ADAPTER_SCORE = 10, 12, 8, 200, 0.3

# What a page shows of its bundler. A signal holds if all its patterns are found.
# adapter, where (html or the name of a header; "name-*" for any header with that beginning), patterns, weight, label
PAGE_SIGNALS = [
    ("angular", "html", [r'\sng-version="\d'], 0.35, "ng-version attribute in server-rendered HTML"),
    ("angular", "html", [r'<script[^>]+src="[^"]*main-[A-Z0-9]{8}\.js"'], 0.35, "Angular CLI entry main-<HASH>.js"),
    ("angular", "html", [r"<(app-root|app-[a-z-]+)[\s>]"], 0.35, "<app-*> root element"),
    ("angular", "html", [r"_nghost-|_ngcontent-"], 0.35, "emulated view encapsulation attributes"),
    ("astro", "html", [r"<astro-island"], 0.7, "<astro-island> components"),
    ("astro", "html", [r"""["']/_astro/[\w.-]+\.(js|css)["']"""], 0.3, "/_astro/ assets"),
    ("astro", "html", [r'<meta name="generator" content="Astro'], 0.4, "generator meta"),
    ("next", "html", [r"/_next/static/"], 0.6, "/_next/static/ assets"),
    ("next", "html", [r"self\.__next_f"], 0.3, "App Router RSC payload (self.__next_f)"),
    ("next", "html", [r"""id=["']__NEXT_DATA__["']"""], 0.3, "Pages Router __NEXT_DATA__"),
    ("next", "html", [r"webpackChunk_N_E|_N_E="], 0.2, "webpack chunk global _N_E"),
    ("next", "html", [r"""<div id=["']__next["']"""], 0.1, "#__next root"),
    ("next", "html", [r"""name=["']next-head-count["']"""], 0.1, "next-head-count meta"),
    ("next", "x-powered-by", [r"(?i)next\.js"], 0.3, "x-powered-by: Next.js"),
    ("next", "x-nextjs-*", [r""], 0.3, "x-nextjs-* headers"),
    ("nuxt", "html", [r"/_nuxt/[\w.-]+\.m?js"], 0.5, "/_nuxt/ module chunks"),
    ("nuxt", "html", [r"""<div id=["']__nuxt["']"""], 0.3, "#__nuxt root"),
    ("nuxt", "html", [r"""id=["']__NUXT_DATA__["']|window\.__NUXT__\s*="""], 0.4, "Nuxt payload (__NUXT_DATA__ / window.__NUXT__)"),
    ("nuxt", "html", [r'"#entry"\s*:'], 0.2, "import map #entry"),
    ("react-router", "html", [r"window\.__reactRouterContext\s*="], 0.7, "React Router framework context (window.__reactRouterContext)"),
    ("react-router", "html", [r"window\.__remixContext\s*="], 0.7, "Remix context (window.__remixContext)"),
    ("react-router", "html", [r"__reactRouterRouteModules|__remixRouteModules"], 0.3, "route modules registry"),
    ("react-router", "html", [r"__reactRouterManifest|__remixManifest"], 0.2, "route manifest"),
    ("rspack", "html", [r"/static/js/lib-(react|router|polyfill|lodash|axios)\.[\w]{8}\.js"], 0.2, "Rsbuild lib-* split chunks"),
    ("rspack", "html", [r"/static/js/(index|main)\.[\w]{8}\.js", r"/static/css/(index|main)\.[\w]{8}\.css"], 0.2, "Rsbuild static/js + static/css layout"),
    ("sveltekit", "html", [r"__sveltekit_\w+\s*="], 0.8, "__sveltekit_* bootstrap"),
    ("sveltekit", "html", [r"/_app/immutable/"], 0.4, "/_app/immutable/ chunks"),
    ("vite", "html", [r'<script[^>]+type="module"[^>]+crossorigin[^>]+src="[^"]*/assets/[\w-]+-[\w-]{8}\.js"'], 0.35, "module script /assets/<name>-<hash>.js with crossorigin"),
    ("vite", "html", [r'rel="modulepreload"[^>]+/assets/'], 0.35, "modulepreload of /assets/"),
    ("webpack", "html", [r"/static/js/(main|runtime|vendors?|bundle)[.~-][\w.]*\.js"], 0.2, "CRA-style /static/js/ bundle names"),
    ("webpack", "html", [r"webpackChunk|webpackJsonp"], 0.2, "webpack global in HTML"),
]
# What scripts show. where: body or url; a label counts once however many scripts show it.
# adapter, where, patterns, weight, label
ASSET_SIGNALS = [
    ("angular", "body", [r"\bstatic\s*(?:\\u0275|ɵ)(?:cmp|fac|prov|pipe|dir|mod|inj)\s*=|\\u0275\\u0275defineComponent|ɵɵdefineComponent"], 0.95, "Ivy definitions (ɵcmp / ɵfac / ɵprov)"),
    ("angular", "body", [r"""["']ng-version["']"""], 0.4, "ng-version attribute"),
    ("esbuild", "body", [r"__commonJS\("], 0.4, "esbuild __commonJS helper"),
    ("esbuild", "body", [r"__toESM\(|__export\("], 0.4, "esbuild interop helpers"),
    ("esbuild", "url", [r"/chunk-[A-Z0-9]{8}\.js"], 0.4, "esbuild chunk-<HASH>.js naming"),
    ("nuxt", "body", [r"__NUXT__"], 0.45, "Nuxt runtime"),
    ("react-router", "body", [r"window\.__(reactRouter|remix)Manifest\s*="], 0.8, "route manifest chunk"),
    ("rspack", "body", [r"""\.ruid\s*=\s*["'`]bundler=rspack@[\w.-]+["'`]"""], 1.0, "rspack runtime"),
    ("vite", "body", [r"__vite__mapDeps|__vitePreload"], 0.35, "vite preload helpers"),
    ("vite", "body", [r'relList\.supports\("modulepreload"\)|rel="modulepreload"'], 0.35, "vite modulepreload polyfill"),
    ("vite", "url", [r"/assets/[\w-]+-[\w-]{8}\.js$"], 0.35, "hashed ES module chunks in /assets/"),
    ("webpack", "body", [r"webpack(Chunk|Jsonp)[\w$]*\s*=\s*[\w$.]+\s*\|\|\s*\[\]\)\.push\(\[\["], 0.45, "webpack JSONP chunk"),
    ("webpack", "body", [r"__webpack_require__|\b[\w$]\.m\s*=\s*[\w$]+,\s*[\w$]\.(cw|c|d|o)\s*="], 0.45, "webpack runtime"),
    ("webpack", "body", [r"\.cw\s*=\s*[\w$]+\s*=>"], 0.45, "webpack commonjs wrappers"),
]
SIGNAL_SCHEMA = "adapter string, place string, patterns array<string>, weight double, label string"

# Services by what their code says. kind, name, pattern, detail
SERVICES = [
    ("auth", "Telegram Login Widget", r"\bTelegram\.Login\.(auth|init)\b|data-telegram-login\b|oauth\.telegram\.org", "login through Telegram"),
    ("mini-app", "Telegram Mini App", r"\bTelegram\.WebApp\b|\binitDataUnsafe\b|tgWebAppData|@telegram-apps/sdk|@twa-dev/sdk", "runs inside Telegram, reads initData"),
    ("auth", "TON Connect", r"\bTonConnect(UI)?\b|tonconnect-manifest\.json", "wallet login through TON Connect"),
    ("auth", "Google Sign-In", r"\bgoogle\.accounts\.(id|oauth2)\.|accounts\.google\.com/(o/oauth2|gsi)", "login through Google"),
    ("auth", "Sign in with Apple", r"\bAppleID\.auth\.|appleid\.apple\.com/auth", "login through Apple"),
    ("auth", "VK ID", r"\bVKID\.|id\.vk\.com/(authorize|auth)|oauth\.vk\.com/authorize", "login through VK"),
    ("auth", "Yandex ID", r"\bYaAuthSuggest\b|oauth\.yandex\.(ru|com)/authorize", "login through Yandex"),
    ("auth", "GitHub OAuth", r"github\.com/login/oauth/authorize", "login through GitHub"),
    ("auth", "Discord OAuth", r"discord(app)?\.com/(api/)?oauth2/authorize", "login through Discord"),
    ("auth", "WebAuthn / passkeys", r"navigator\.credentials\.(create|get)\b|PublicKeyCredential\b", "passkey login"),
    ("auth", "Firebase Auth", r"identitytoolkit\.googleapis\.com|\bsignInWithPopup\b|\bsignInWithEmailAndPassword\b", "Firebase Authentication"),
    ("auth", "Supabase Auth", r"/auth/v1/(token|authorize|otp|signup)", "Supabase Auth"),
    ("auth", "Clerk", r"\bclerk\.(browser|accounts)\.|__clerk_db_jwt|\bClerkProvider\b", "Clerk"),
    ("auth", "Auth0", r"\.auth0\.com/authorize|\bAuth0Provider\b|auth0-spa-js", "Auth0"),
    ("auth", "NextAuth", r"/api/auth/(session|csrf|providers|callback|signin)", "NextAuth / Auth.js endpoints"),
    ("captcha", "Cloudflare Turnstile", r"challenges\.cloudflare\.com/turnstile|\bturnstile\.(render|execute|reset)\b|cf-turnstile", "captcha"),
    ("captcha", "reCAPTCHA", r"\bgrecaptcha\.(execute|render|ready)\b|google\.com/recaptcha/", "captcha"),
    ("captcha", "hCaptcha", r"\bhcaptcha\.(render|execute)\b|js\.hcaptcha\.com", "captcha"),
    ("captcha", "Yandex SmartCaptcha", r"smartcaptcha\.yandexcloud\.net|\bsmartCaptcha\.(render|execute)\b", "captcha"),
]
# Third-party scripts by host and path; the first that matches names the service.
THIRD_PARTIES = [
    (r"^telegram\.org/js/telegram-widget\.js", "Telegram Login Widget"),
    (r"^telegram\.org/js/telegram-web-app\.js", "Telegram Mini App SDK"),
    (r"^accounts\.google\.com/gsi/", "Google Sign-In"),
    (r"^apis\.google\.com/js/platform\.js", "Google Sign-In (legacy)"),
    (r"^challenges\.cloudflare\.com/turnstile/", "Cloudflare Turnstile"),
    (r"^(www\.)?(google\.com|recaptcha\.net|gstatic\.com)/recaptcha/", "reCAPTCHA"),
    (r"^(js\.)?hcaptcha\.com/", "hCaptcha"),
    (r"^(unpkg\.com/@vkid|vk\.com/js/api/openapi\.js)", "VK ID"),
    (r"^yastatic\.net/s3/passport-sdk/", "Yandex ID"),
    (r"^appleid\.cdn-apple\.com/appleauth/", "Sign in with Apple"),
    (r"^connect\.facebook\.net/", "Facebook SDK"),
    (r"^js\.stripe\.com/", "Stripe.js"),
    (r"^mc\.yandex\.ru/", "Yandex Metrika"),
    (r"^www\.googletagmanager\.com/", "Google Tag Manager"),
]
# Kinds of strings; the first that matches counts, else it is text.
STRING_KINDS = [
    ("url", r"(?i)^(https?:|wss?:)?//[\w.-]+"),
    ("endpoint", r"(?i)^/(api|graphql|v\d+|rest|rpc|trpc|auth|oauth)(/|$|\?)|/api/"),
    ("path", r"^/[\w\-.~%@:\[\]]+(/[\w\-.~%@:\[\]]*)*(\?.*)?$"),
    ("email", r"^[\w.+-]+@[\w-]+\.[\w.-]+$"),
]
# UI frameworks by their runtimes' marks, in the order that settles ties.
FRAMEWORKS = [
    ("react", r"react\.(transitional\.)?element|__SECRET_INTERNALS|__CLIENT_INTERNALS_DO_NOT_USE|\bjsxs?\(|useState\("),
    ("vue", r"__vccOpts|__scopeId|\b__name\s*:|createElementVNode|openBlock\(|defineStore\("),
    ("svelte", r"svelte-[a-z0-9]{6}|\$\$props|\$\.template\(|append_styles|svelte/internal"),
]
# Inline scripts that frameworks write.
FRAMEWORK_SCRIPTS = [
    r"^\s*(?:\$R[A-Z]\s*=|requestAnimationFrame\(\s*function\s*\(\)\s*\{\s*\$RT\s*=)",
    r"^\s*window\.__(?:reactRouter|remix)Context\s*=",
    r"^\s*window\.__(?:reactRouter|remix)Context\.streamController\.(?:enqueue|close)\(",
    r"window\.__(?:reactRouter|remix)RouteModules\s*=",
    r"""\bself\.Astro\b|["']astro-island["']|["']astro:(?:load|idle|visible|media|only)["']""",
    r"reactrouter\.com/start/framework/route-module#hydratefallback",
    r"""(?s)["']nuxt-color-mode["'].*data-color-mode-forced|data-color-mode-forced.*["']nuxt-color-mode["']""",
    r"""^\s*document\.querySelectorAll\(["']link\[data-(?:beasties|critters)-media\]["']\)""",
]
# Counters of generated module code.
BOILERPLATE = [
    ("define_exports", r"Object\.defineProperty\(exports,"),
    ("exports_assignments", r"(?m)(^|[^.\w$])exports\.[\w$]+\s*="),
    ("require_calls", r"(?m)(^|[^.\w$])require\("),
    ("indirect_calls", r"\(0,\s*[\w$.]+\)\("),
]
# Algorithms by constants in their code: name, label, initial values, tables, strings, least hits.
CRYPTO = [
    ("sha256", "SHA-256", [0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F], [0x428A2F98, 0x71374491, 0xB5C0FBCF, 0xE9B5DBA5, 0x3956C25B], [], 2),
    ("sha224", "SHA-224", [0xC1059ED8, 0x367CD507, 0x3070DD17, 0xF70E5939], [], [], 2),
    ("sha512", "SHA-512", [0xF3BCC908, 0x84CAA73B, 0xFE94F82B, 0x5F1D36F1], [0xD728AE22, 0x23EF65CD, 0xEC4D3B2F, 0x8189DBBC], [], 2),
    ("md5", "MD5", [], [0xD76AA478, 0xE8C7B756, 0x242070DB, 0xC1BDCEEE, 0xF57C0FAF], [], 2),
    ("sha1", "SHA-1", [0xC3D2E1F0], [0x5A827999, 0x6ED9EBA1, 0x8F1BBCDC, 0xCA62C1D6], [], 2),
    ("crc32", "CRC-32", [], [0xEDB88320, 0x77073096, 0xEE0E612C], [], 1),
    ("murmurhash3", "MurmurHash3", [], [0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35], [], 2),
    ("fnv1a", "FNV-1a", [0x811C9DC5], [0x01000193], [], 2),
    ("xxhash32", "xxHash32", [], [0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], [], 2),
    ("chacha20", "ChaCha20", [0x61707865, 0x3320646E, 0x79622D32, 0x6B206574], [], ["expand 32-byte k"], 2),
    ("base64", "Base64 alphabet", [], [], ["ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"], 1),
]
# An algorithm is not reported beside one that contains it.
CRYPTO_CONTAINED = [("sha1", "md5"), ("sha224", "sha256")]
# Paths that no crawl follows, and extensions of what is no page.
UNSAFE_ROUTE = r"(?i)(^|/)(api|graphql|trpc|logout|log-out|signout|sign-out|delete|remove|destroy|unsubscribe|oauth|callback|webhooks?)(/|$)"
# Prefixes that bundlers put before source paths; the first that matches is taken off.
SOURCE_PREFIXES = [r"^webpack://[^/]*/", r"^turbopack:///?", r"^rollup:///?", r"^vite:///?", r"^file:///?", r"(?i)^[a-z][a-z0-9+.-]*://[^/]*/"]
# Names of seconds and milliseconds that code uses as constants.
DURATIONS = {
    31536000: "ONE_YEAR", 2592000: "THIRTY_DAYS", 604800: "ONE_WEEK", 86400: "ONE_DAY", 3600: "ONE_HOUR", 31557600000: "ONE_YEAR_MS",
    31536000000: "ONE_YEAR_MS", 2592000000: "THIRTY_DAYS_MS", 604800000: "ONE_WEEK_MS", 86400000: "ONE_DAY_MS", 3600000: "ONE_HOUR_MS", 60000: "ONE_MINUTE_MS",
}
# Short names that people write by hand.
SHORT_NAMES = ["i", "j", "k", "x", "y", "z", "id", "el", "fn", "cb", "ok", "to", "on", "db", "io", "ui", "op", "$", "_"]
# Verbs that begin function names; a capital follows.
VERBS = ["get", "fetch", "create", "load", "read", "find", "compute", "build", "make", "resolve", "select", "use", "calc", "calculate", "parse"]
# Words that say nothing of what a storage key holds.
GENERIC_KEY_WORD = r"^(key|data|value|state|store|storage|cache|v\d+|app|admin|user|site)$"
# Extensions of what is no page, labels of hosts that say nothing of the site.
NON_PAGE = r"(?i)\.(js|mjs|css|map|json|png|jpe?g|gif|svg|webp|avif|ico|woff2?|ttf|otf|mp4|webm|mp3|pdf|zip|txt|xml)$"
GENERIC_LABEL = r"^(www|app|admin|api|static|cdn|assets|web|site|home|dev|test|stage|staging|beta|demo|xn--[a-z0-9-]+)$"
# Features that every module has, and the thresholds of recognition.
GENERIC_FEATURES = ["P:length", "P:call", "P:apply", "P:prototype", "P:push", "P:then", "P:default", "P:exports"]
MIN_MODULE_FEATURES, MODULE_THRESHOLD = 8, 0.6

# Elements that no loop writes.
NEVER_REPEATED = ("script", "style", "pre", "textarea", "svg", "path", "head", "html", "body", "title", "meta", "link", "option", "br", "hr", "img", "input")
