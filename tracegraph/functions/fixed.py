"""Word lists, patterns and constants that results depend on."""

# ---- feature view word lists (fixed values) ----
VIEW_SUSPICIOUS_TLDS = "xyz top club buzz tk ml ga cf gq work life online site icu fun info cc pw".split()
URL_LOGIN_WORDS = "login signin verify secure update confirm account password credential banking".split()
URL_BRAND_WORDS = "paypal apple microsoft google amazon facebook netflix chase wellsfargo".split()
TITLE_LOGIN_WORDS = ["login", "signin", "sign in", "log in", "verify", "verification", "secure", "update",
                     "confirm", "password"]
TITLE_BRAND_WORDS = ("paypal apple microsoft google amazon facebook netflix chase wellsfargo bank dropbox adobe "
                     "office outlook icloud").split()
TITLE_URGENCY_WORDS = "urgent immediate suspend locked expire unauthorized alert warning limited".split()
CDN_WORDS = "cdn cloudfront cloudflare akamai fastly jsdelivr".split()
FREE_HOSTING = ["weebly", "wix", "webflow", "000webhostapp", "sites.google", "firebase", "herokuapp", "netlify",
                "vercel", "github.io", "blogspot", "wordpress.com", "square.site"]
SHORTENERS = ["bit.ly", "tinyurl.com", "t.co", "goo.gl", "is.gd", "rb.gy"]
SENSITIVE_FIELD_WORDS = "password pass pwd email ssn card credit".split()

# ---- domain rule word lists, 0..1 scale (fixed values) ----
TARGET_BRANDS = (
    "paypal apple microsoft google amazon netflix facebook instagram whatsapp chase wellsfargo bankofamerica "
    "citibank usbank capitalone amex americanexpress discover coinbase binance metamask blockchain ledger opensea "
    "dropbox onedrive icloud outlook office365 office linkedin twitter tiktok snapchat telegram signal zoom webex "
    "teams slack discord ebay walmart target bestbuy costco usps fedex ups dhl royalmail irs hmrc gov tax medicare "
    "hsbc barclays natwest santander ing docusign adobe salesforce zendesk shopify stripe square venmo cashapp "
    "zelle steam epic roblox playstation nintendo").split()
PHISH_KEYWORDS = (
    "login signin sign-in logon log-on verify verification secure security update confirm account suspend locked "
    "unlock restore recover reset password credential authenticate validate billing payment invoice refund alert "
    "urgent immediate expire expired limited unusual activity unauthorized compromised wallet connect swap bridge "
    "claim reward airdrop mint stake defi").split()
HIGH_RISK_TLDS = ("tk ml ga cf gq xyz top club online site icu buzz cyou rest shop work life fun uno cam wang vip "
                  "cc live best").split()
ABUSED_HOSTS = (
    "pages.dev workers.dev netlify.app vercel.app herokuapp.com firebaseapp.com web.app github.io gitlab.io "
    "blogspot.com weebly.com wixsite.com godaddysites.com square.site myshopify.com carrd.co 000webhostapp.com "
    "infinityfreeapp.com repl.co glitch.me ngrok.io trycloudflare.com").split()

# ---- domain points, brand dictionary with look-alike spellings (fixed values) ----
CT_BRAND_KEYWORDS = [
    ("paypal", ["paypal", "paypa1", "paipal", "paypaì", "paypol"]),
    ("apple", ["apple", "app1e", "appie", "icloud", "icl0ud"]),
    ("microsoft", ["microsoft", "micr0soft", "microsft", "microsoftt", "office365", "outlook", "0utlook",
                   "onedrive"]),
    ("google", ["google", "go0gle", "g00gle", "gogle"]),
    ("amazon", ["amazon", "amaz0n", "amazone", "arnazon"]),
    ("netflix", ["netflix", "netfIix", "netfl1x", "neftlix"]),
    ("chase", ["chase", "jpmorgan"]),
    ("wellsfargo", ["wellsfargo", "wells-fargo", "wf-login"]),
    ("bankofamerica", ["bankofamerica", "bofa", "bank0famerica"]),
    ("coinbase", ["coinbase", "c0inbase", "coinbse"]),
    ("binance", ["binance", "b1nance", "binanсe"]),
    ("facebook", ["facebook", "faceb00k", "facebok", "fb-login"]),
    ("instagram", ["instagram", "instagr4m", "lnstagram", "instagramm"]),
    ("linkedin", ["linkedin", "linked1n", "linkediη"]),
    ("dropbox", ["dropbox", "dr0pbox", "dropb0x"]),
    ("docusign", ["docusign", "docu-sign", "d0cusign"]),
    ("dhl", ["dhl", "dh1"]),
    ("usps", ["usps", "us-postal", "uspostal"]),
    ("fedex", ["fedex", "f3dex", "fed-ex"]),
]
CT_OFFICIAL = {
    "paypal": "paypal.com paypalinc.com paypalcorp.com paypal.cn paypal.me paypalcredit.com braintreepayments.com "
              "braintree-api.com braintree.tools hyperwallet.com honey-images.com loanbuilder.com".split(),
    "apple": "apple.com icloud.com apple.co cdn-apple.com apple.news apple-dns.net apple-cloudkit.com "
             "apple-mapkit.com appstoreconnect.apple.com".split(),
    "microsoft": "microsoft.com microsoftonline.com msft.net azure.com office.com live.com outlook.com hotmail.com "
                 "msedge.net windowsupdate.com msftconnecttest.com windows.com microsoft.net office365.com "
                 "onedrive.com sharepoint.com skype.com xbox.com bing.com visualstudio.com github.com".split(),
    "google": "google.com googleapis.com gstatic.com google.co googlesyndication.com googleadservices.com "
              "google.cloud google.org youtube.com goo.gl google.cn g.co withgoogle.com googleusercontent.com "
              "googlevideo.com".split(),
    "amazon": "amazon.com amazon.co.uk amazon.de amazon.fr amazon.co.jp amazonaws.com amazontrust.com amazon.in "
              "amazon.ca amazon.cn amzn.com prime.amazon amazon.com.au".split(),
    "netflix": "netflix.com netflix.net nflxext.com nflximg.net nflxso.net nflxvideo.net netflix.ca".split(),
    "chase": "chase.com jpmorganchase.com jpmorgan.com jpmchase.net jpmchase.com".split(),
    "wellsfargo": "wellsfargo.com wf.com wellsfargoadvisors.com".split(),
    "bankofamerica": "bankofamerica.com bofa.com bofaml.com ml.com merrilledge.com merrilllynch.com".split(),
    "coinbase": "coinbase.com coinbase-staking.com".split(),
    "binance": "binance.com binance.org binance.us bnbchain.org".split(),
    "facebook": "facebook.com fb.com fbcdn.net facebook.net meta.com instagram.com whatsapp.com".split(),
    "instagram": "instagram.com cdninstagram.com".split(),
    "linkedin": "linkedin.com licdn.com".split(),
    "dropbox": "dropbox.com dropboxapi.com".split(),
    "docusign": "docusign.com docusign.net".split(),
    "dhl": "dhl.com dhl.de".split(),
    "usps": ["usps.com"],
    "fedex": ["fedex.com"],
}
CT_INDICATORS = (
    "login signin sign-in logon signon sign-on verify verification validate confirm confirmation secure security "
    "safety protect account acct myaccount update upgrade renew renewal recover recovery restore unlock support "
    "helpdesk help-desk service billing invoice payment pay wallet password reset credential alert warning "
    "suspended limited restricted claim reward prize giveaway free web online portal app mobile").split()
CT_TLDS = (
    "xyz top club online site info click link buzz space fun icu cam rest monster surf wang work gq cf ga ml tk pw "
    "cc us ws to ly life live today world digital tech store shop app dev cfd").split()
CT_HOSTING = ["blogspot", "wordpress", "wixsite", "weebly", "netlify", "herokuapp", "github.io", "firebase",
              "web.app", "pages.dev", "vercel", "duckdns", "no-ip", "ddns"]
LIVE_BRAND_KEYWORDS = [
    ("paypal", ["paypal", "paypa1", "paipal"]), ("apple", ["apple", "app1e", "icloud"]),
    ("microsoft", ["microsoft", "office365", "outlook"]), ("google", ["google", "gmail"]),
    ("amazon", ["amazon", "amaz0n"]), ("netflix", ["netflix", "netfIix"]), ("chase", ["chase"]),
    ("facebook", ["facebook", "faceb00k"]), ("instagram", ["instagram", "lnstagram"]),
    ("coinbase", ["coinbase"]), ("binance", ["binance"]), ("dhl", ["dhl"]), ("usps", ["usps"]),
    ("wellsfargo", ["wellsfargo", "wells-fargo"]), ("bankofamerica", ["bankofamerica", "bofa"]),
]
LIVE_OFFICIAL = {
    "paypal": "paypal.com paypalinc.com braintreepayments.com hyperwallet.com paypal.me".split(),
    "apple": "apple.com icloud.com cdn-apple.com apple.news".split(),
    "microsoft": "microsoft.com live.com outlook.com office.com hotmail.com azure.com msft.net onedrive.com "
                 "sharepoint.com github.com".split(),
    "google": "google.com googleapis.com gstatic.com youtube.com gmail.com".split(),
    "amazon": "amazon.com amazonaws.com amazontrust.com amzn.com amazon.co.uk".split(),
    "netflix": "netflix.com nflxext.com nflximg.net".split(),
    "chase": "chase.com jpmorganchase.com".split(),
    "facebook": "facebook.com fb.com fbcdn.net meta.com instagram.com".split(),
    "instagram": "instagram.com cdninstagram.com".split(),
    "coinbase": ["coinbase.com"], "binance": "binance.com binance.org".split(), "dhl": "dhl.com dhl.de".split(),
    "usps": ["usps.com"], "wellsfargo": "wellsfargo.com wf.com".split(),
    "bankofamerica": "bankofamerica.com bofa.com".split(),
}
LIVE_INDICATORS = (
    "login signin sign-in logon verify verification validate confirm secure security account update recover unlock "
    "support billing payment wallet password reset alert suspended limited restricted reward giveaway").split()
LIVE_TLDS = ("xyz top club online site info click link buzz icu cam rest monster cfd sbs quest gq cf ga ml tk pw cc "
             "ws ru cn su").split()

# ---- live feed filter (fixed values) ----
FEED_BRANDS = (
    "paypal apple microsoft google amazon netflix chase facebook instagram coinbase binance dhl usps wellsfargo "
    "dropbox linkedin docusign fedex outlook office365 gmail icloud whatsapp telegram steam roblox stripe venmo "
    "adobe twitter").split()
FEED_TLDS = ("xyz top club online site info click buzz icu cam rest monster cfd sbs gq cf ga ml tk pw cc app dev "
             "io").split()
FEED_KEYWORDS = ("login signin verify secure account update unlock billing payment wallet password reset suspended "
                 "confirm auth bank webmail recover").split()
ALLOWED_DOMAINS = (
    "google.com microsoft.com apple.com amazon.com facebook.com netflix.com paypal.com github.com linkedin.com "
    "twitter.com instagram.com youtube.com wikipedia.org reddit.com stackoverflow.com cloudflare.com akamai.com "
    "fastly.net login.microsoftonline.com accounts.google.com appleid.apple.com outlook.live.com live.com "
    "office.com office365.com googleapis.com gstatic.com microsoftonline.com").split()
OFFICIAL_SUFFIXES = "gov edu mil gov.uk ac.uk".split()

# ---- infrastructure exclusions (fixed values) ----
INFRA_PATTERN = (r"(?i)(?:awsdns-|akamai|cloudflare-dns|fastly-analytics|edgecast|limelight|gtld-servers|"
                 r"root-servers|registrar-servers|in-addr\.arpa|ip6\.arpa|ntp\d*\.|dns\d*\.|ns\d*\.|mx\d*\.|"
                 r"smtp\d*\.)")
INFRA_SUFFIXES = ("amazonaws.com cloudfront.net akamaiedge.net akamai.net akadns.net edgekey.net edgesuite.net "
                  "fastly.net azurefd.net trafficmanager.net vo.msecnd.net azureedge.net").split()
RANKED_INFRA_WORDS = (
    "awsdns akamai cloudfront amazonaws fastly edgecast limelight gtld-servers root-servers registrar-servers akadns "
    "edgekey edgesuite azurefd trafficmanager msecnd azureedge cloudflare-dns in-addr.arpa ip6.arpa").split()
RANKED_INFRA_TLDS = "arpa internal local test".split()
BINARY_EXT_PATTERN = r"(?i)\.(?:exe|msi|dll|sh|bin|elf|arm[v\d]*|bat|cmd|ps1|vbs|jar|apk|deb|rpm|iso|img)$"
IP_SINGLE_LETTER_PATTERN = r"^https?://\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?::\d+)?/[a-zA-Z]/?$"

# ---- trace quality patterns, tried in this order (fixed values) ----
ERROR_PATTERNS = [
    r"404\s*[-–—]\s*(?:page\s*)?not\s*found", r"403\s*[-–—]\s*forbidden",
    r"500\s*[-–—]\s*(?:internal\s*)?server\s*error", r"502\s*[-–—]\s*bad\s*gateway",
    r"503\s*[-–—]\s*service\s*unavailable", r"access\s*denied",
    r"this\s*page\s*(?:is\s*)?(?:not|no\s*longer)\s*(?:available|found)",
    r"page\s*(?:could\s*)?not\s*(?:be\s*)?found",
    r"the\s*(?:requested\s*)?(?:page|resource|url)\s*(?:was\s*)?not\s*found",
    r"(?:^|\b)error\s+(?:code\s+)?\d{3}\b", r"server\s*error",
    r"website\s*(?:is\s*)?(?:offline|down|unavailable)", r"this\s*site\s*can(?:'t|\s*not)\s*be\s*reached",
    r"connection\s*(?:refused|timed?\s*out|reset)", r"dns\s*(?:resolution|lookup)\s*failed",
]
PARKING_PATTERNS = [
    r"(?:buy|purchase)\s*this\s*domain", r"domain\s*(?:is\s*)?for\s*sale",
    r"this\s*domain\s*(?:has\s*)?(?:expired|is\s*available)", r"domain\s*parking", r"coming\s*soon",
    r"under\s*construction", r"parked\s*(?:free|domain)",
    r"(?:dan|sedo|afternic|godaddy)\s*(?:domain\s*)?(?:parking|marketplace)", r"this\s*webpage\s*is\s*parked",
    r"domain\s*(?:name\s*)?(?:registration|registrar)", r"hugedomains\.com", r"namecheap\s*(?:parking|redirect)",
]
CAPTCHA_PATTERNS = [
    r"cloudflare.*(?:checking|verify|challenge)", r"attention\s*required.*cloudflare",
    r"please\s*(?:wait|verify|complete)", r"(?:h|re)captcha", r"bot\s*(?:detection|protection|verification)",
    r"ddos\s*protection", r"just\s*a\s*moment", r"verifying\s*(?:you\s*are|that\s*you)", r"ray\s*id",
    r"challenge-platform",
]
BLANK_PREFIXES = ["about:blank", "data:text/html"]
ERROR_STATUS = [400, 401, 403, 404, 405, 408, 410, 429, 500, 502, 503, 504]
POST_ERROR_PATTERN = (r"\b(403|404|500|502|503)\b|forbidden|not\s*found|access\s*denied|error\s*page|server\s*error|"
                      r"bad\s*gateway|service\s*unavailable|page\s*not\s*found|site\s*not\s*found|"
                      r"domain\s*for\s*sale|parked\s*domain|coming\s*soon|under\s*construction")
LOGIN_LINK_PATTERN = (r"log\s*in|sign\s*in|sign\s*up|register|my\s*account|connexion|anmelden|iniciar\s*ses|entrar|"
                      r"accedi|inloggen|войти|ログイン|登录")
SUCCESS_PHRASES = ["welcome", "dashboard", "logged in", "sign out", "my account", "your account", "inbox", "log out",
                   "successfully", "verification complete", "thank you"]
ERROR_PHRASES = [
    "incorrect password", "wrong password", "invalid password", "authentication failed", "login failed", "try again",
    "invalid credentials", "account not found", "error", "mot de passe incorrect", "contraseña incorrecta",
    "password is incorrect", "please try again", "unable to sign in", "sign-in failed", "account does not exist",
    "user not found"]

# ---- query mining lists (fixed values) ----
QUERY_BRANDS = [
    "paypal", "apple", "microsoft", "google", "amazon", "netflix", "facebook", "instagram", "chase", "wellsfargo",
    "bank of america", "coinbase", "binance", "metamask", "outlook", "office 365", "linkedin", "twitter", "dropbox",
    "docusign", "adobe", "usps", "fedex", "dhl", "whatsapp", "telegram", "steam", "roblox", "epic games", "stripe",
    "venmo", "cashapp", "walmart", "ebay", "target", "costco", "bestbuy", "hsbc", "barclays", "citibank",
    "capital one", "american express", "blockchain", "opensea", "ledger", "crypto.com", "trust wallet"]
QUERY_ACTIONS = ["login", "sign in", "log in", "verify", "confirm", "update", "secure", "unlock", "restore",
                 "recover", "reset password", "authenticate", "validate", "connect wallet", "claim reward", "airdrop"]
QUERY_URGENCY = ["urgent", "immediately", "suspended", "locked", "unusual activity", "unauthorized", "expire",
                 "limited time", "action required", "verify identity", "security alert", "compromised",
                 "confirm account"]
QUERY_TECHNICAL = ["login.php", "signin.html", "verify.php", "webmail", "secure-login", "account-update",
                   "billing-update", "password-reset", "confirm-identity", "wallet-connect", "customer-support",
                   "help-center"]
QUERY_CATEGORIES = [
    ("credential_harvest", 3.0, ["{brand} login", "{brand} sign in page", "{brand} verify account"]),
    ("brand_impersonation", 2.0, ["{brand} official site", "{brand} customer service", "{brand} help center"]),
    ("financial_fraud", 2.5, ["{brand} payment update", "{brand} billing verify", "{brand} refund process"]),
    ("crypto_scam", 2.0, ["connect wallet {brand}", "{brand} airdrop claim", "{brand} free tokens",
                          "defi swap {brand}"]),
    ("urgency_social_eng", 2.5, ["{brand} {urgency}", "{brand} account {urgency}"]),
    ("technical_phishing", 1.5, ["{brand} {tech_pattern}", "webmail {brand} login"]),
]
SNIPPET_PHRASES = [
    "verify your", "confirm your", "update your", "secure your", "unusual activity", "suspended", "locked",
    "unauthorized", "click here to", "enter your password", "login required", "account verification",
    "identity verification", "security alert", "reset your password", "claim your", "free reward",
    "limited time offer", "act now", "immediate action", "connect your wallet", "claim airdrop", "mint now"]
SERP_PATHS = ["/login", "/signin", "/verify", "/secure", "/update", "/confirm", "/account", "/wallet", "/connect"]

# ---- squat shapes (fixed values) ----
SQUAT_INDICATORS = "login signin verify secure account update support wallet".split()
SQUAT_TLDS = "xyz top club online site info app icu cc buzz".split()
AFFIX_TLDS = "com net org xyz top app site online info club".split()
AFFIX_PREFIXES = ["login-", "secure-", "verify-", "account-", "my-", "web-", "signin-"]
AFFIX_SUFFIXES = ["-login", "-secure", "-verify", "-account", "-support", "-help"]

# ---- two-label public suffixes; any other last label is its own suffix (fixed values) ----
TWO_LABEL_SUFFIXES = ("co.uk org.uk gov.uk ac.uk com.au net.au org.au co.jp ne.jp com.br com.cn com.mx com.tr co.in "
                      "co.kr co.nz co.za com.sg com.hk com.tw").split()

# ---- column names of the feature views, in order (fixed values) ----
URL_COLS = ("url_len domain_len path_len num_dots num_dashes num_underscores num_slashes num_at num_digits_domain "
            "has_ip has_https has_suspicious_tld num_subdomains num_params has_encoded domain_entropy path_entropy "
            "kw_login brand_in_url domain_changed path_depth").split()
NETWORK_COLS = ("total_requests n_scripts n_stylesheets n_images n_xhr n_documents n_fonts unique_domains ext_ratio "
                "cdn_ratio n_2xx n_4xx n_5xx content_type_diversity load_duration avg_interval script_ratio "
                "xhr_ratio").split()
REDIRECT_COLS = ("num_redirects unique_domains cross_domain_redirects http_to_https domain_changed num_3xx "
                 "num_doc_requests external_ratio chain_length uses_free_hosting uses_shortener "
                 "total_network_requests external_requests extra_hops").split()
CONTENT_COLS = ("title_has_login title_has_brand title_has_urgency title_length title_entropy n_links n_buttons "
                "n_inputs n_submits n_checks total_events has_password_field has_email_field interaction_duration "
                "forms_submitted dual_submissions n_dual_submit input_ratio").split()
ITG_COLS = ("num_nodes num_edges avg_degree max_degree graph_density clustering_coefficient "
            "num_connected_components avg_path_length diameter num_forms num_redirects has_password_input "
            "has_email_input external_redirects num_input_fields num_buttons num_links max_redirect_depth "
            "form_to_node_ratio total_interaction_time avg_time_between_events event_frequency "
            "betweenness_centrality_max closeness_centrality_max pagerank_max in_degree_max out_degree_max "
            "requests_sensitive_data credential_fields_count financial_fields_count").split()
ITG_CATEGORIES = {
    "topological": ITG_COLS[0:9], "behavioral": ITG_COLS[9:19], "temporal": ITG_COLS[19:22],
    "centrality": ITG_COLS[22:27], "sensitive_data": ITG_COLS[27:30],
}
# ---- truncation levels: name, events kept, redirects kept (fixed values) ----
TRUNCATION_LEVELS = [("0-evt", 0, 0), ("1-evt", 1, 0), ("3-evt", 3, 1), ("8-evt", 8, 1), ("15-evt", 15, 1),
                     ("all", 1 << 62, 1 << 62)]  # all: no limit
# ---- column subsets of the comparison methods (fixed values) ----
METHOD_COLUMNS = {
    "crp_mlp": ("has_password_input has_email_input num_forms num_input_fields credential_fields_count "
                "form_to_node_ratio num_buttons requests_sensitive_data financial_fields_count num_links num_nodes "
                "graph_density").split(),
    "redirect_gbm": ("num_redirects external_redirects max_redirect_depth out_degree_max num_edges "
                     "num_connected_components avg_path_length diameter").split(),
    "url_rf": "num_links num_nodes num_edges graph_density num_redirects max_redirect_depth".split(),
    "visual_mlp": ("num_buttons num_links clustering_coefficient betweenness_centrality_max "
                   "closeness_centrality_max pagerank_max num_input_fields").split(),
    "all_rf": ITG_COLS,
    "behaviour_gbm": ("total_interaction_time avg_time_between_events event_frequency requests_sensitive_data "
                      "credential_fields_count financial_fields_count num_forms has_password_input has_email_input "
                      "num_redirects external_redirects").split(),
    "topology_svm": ("avg_degree max_degree graph_density clustering_coefficient betweenness_centrality_max "
                     "pagerank_max in_degree_max out_degree_max").split(),
    "vote_all": ITG_COLS,
}
# ---- feature pairs of the structural proxies (fixed values) ----
PROXY_PAIRS = [
    ("num_forms", "has_password_input"), ("credential_fields_count", "num_redirects"),
    ("external_redirects", "graph_density"), ("form_to_node_ratio", "credential_fields_count"),
    ("num_input_fields", "has_email_input"), ("betweenness_centrality_max", "num_forms"),
    ("pagerank_max", "credential_fields_count"), ("clustering_coefficient", "num_redirects"),
    ("avg_degree", "form_to_node_ratio"), ("max_degree", "num_forms"), ("diameter", "external_redirects"),
    ("num_nodes", "num_forms"), ("graph_density", "has_password_input"),
    ("closeness_centrality_max", "financial_fields_count"), ("in_degree_max", "out_degree_max"),
    ("num_buttons", "num_forms")]
# ---- decoys of the robustness transforms (fixed values) ----
DECOY_KINDS = [("a", "footer-link", "link_detected"), ("a", "nav-item", "link_detected"),
               ("button", "menu-toggle", "button_detected"), ("div", "breadcrumb", "navigation"),
               ("a", "logo-link", "link_detected")]
DECOY_HOSTS = ["help.example.com", "support.microsoft.com", "news.google.com", "en.wikipedia.org", "docs.github.com",
               "faq.example.org", "blog.cloudflare.com", "status.aws.amazon.com"]
CLEAN_HOSTS = ["secure-update.microsoft-verify.com", "login.accounts-service.net", "portal.cloud-services.org"]
