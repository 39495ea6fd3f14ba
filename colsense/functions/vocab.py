"""Vocabularies, format rules and field types."""

from __future__ import annotations

# Gender terms, matched whole.
GENDER = {
    "male": "mr mister male man boy he him m".split(),
    "female": "mrs ms miss female woman girl she her f".split(),
    "non-binary": "nonbinary non-binary nb they them enby xem".split(),
}

# Job-title terms by family, matched as words inside a value.
JOB_TITLES = {
    "executive": "ceo,cto,cfo,cio,president,vp,director,head,chief,principal,founder,co-founder,owner,partner,gm,executive,chair,board,leadership,c-suite",
    "engineering": "engineer,software,systems,network,devops,data,ml,ai,developer,programmer,coder,dev,architect,sre,qa,test,backend,frontend,fullstack,mobile,it,tech,cloud,cyber,database,sysadmin,technician,mechanic",
    "medical": "doctor,physician,surgeon,md,dentist,nurse,therapist,psychologist,psychiatrist,pharmacist,health,medical,clinic,hospital,care,wellness,specialist,scientist,physio,promo,haematologist,radiographer,nutritionist,occupational,paramedic,technician,assistant,technologist",
    "creative": "designer,ux,ui,graphic,art,creative,editor,writer,content,media,producer,journalist,reporter,photographer,video,multimedia,illustrator,artist,composer,director,curator,copywriter,commissioning",
    "business": "sales,account,rep,agent,business,marketing,growth,brand,advertising,digital,seo,buyer,merchant,retail,wholesale,trade,commerce,broker,consultant,advisor,analyst",
    "support": "support,help,customer,service,admin,administrator,assistant,coordinator,operator,officer,receptionist,secretary,clerk,dispatcher,attendant",
    "finance": "accountant,finance,banker,cashier,audit,tax,investor,fund,wealth,insurance,actuary,bookkeeper,controller,treasurer,trader,broker,teller",
    "hr": "hr,human,resource,recruiter,talent,personnel,training,coach,trainer,mentor,l&d,staffing,payroll",
    "operations": "operations,ops,logistic,supply,warehouse,project,manager,coordinator,planner,procurement,inventory,facilities,maintenance,technician",
    "legal": "lawyer,attorney,solicitor,judge,legal,paralegal,compliance,regulatory,contract,policy,risk,officer",
    "education": "teacher,professor,lecturer,instructor,tutor,educator,principal,dean,coach,trainer,mentor,counselor,academic,scholar",
    "scientific": "scientist,researcher,biologist,chemist,physicist,geologist,analyst,lab,laboratory,biology,chemistry,physics,math,statistic,technician",
    "seniority": "senior,sr,junior,jr,mid,mid-level,lead,principal,staff,distinguished,fellow,master,expert,specialist,associate",
    "management": "manage,manager,director,supervisor,team lead,head,chief,boss,oversee,control,superintendent,foreman",
    "worker": "worker,operator,technician,mechanic,driver,pilot,officer,agent,rep,clerk,assistant,helper,aide,attendant",
}

# Digest kinds by length of the untrimmed value.
DIGEST_LENGTHS = (("md5", 32), ("sha1", 40), ("sha224", 56), ("sha256", 64), ("sha384", 96), ("sha512", 128))

# Address kinds by the form of the trimmed value, in order.
ADDRESS_FORMS = (
    ("bitcoin-legacy", "[1][a-km-zA-HJ-NP-Z1-9]{25,34}"),
    ("bitcoin-script", "[3][a-km-zA-HJ-NP-Z1-9]{25,34}"),
    ("bitcoin-segwit", "(bc1)[a-z0-9]{39,59}"),
    ("bitcoin-taproot", "(bc1p)[a-z0-9]{58}"),
    ("bitcoin-testnet", "[mn2][a-km-zA-HJ-NP-Z1-9]{25,34}"),
    ("bitcoin-testnet-segwit", "(tb1)[a-z0-9]{39,59}"),
    ("ethereum-address", "0x[a-fA-F0-9]{40}"),
    ("ethereum-tx-hash", "0x[a-fA-F0-9]{64}"),
    ("litecoin-legacy", "[L][a-km-zA-HJ-NP-Z1-9]{26,33}"),
    ("litecoin-script", "[M][a-km-zA-HJ-NP-Z1-9]{26,33}"),
    ("litecoin-segwit", "(ltc1)[a-z0-9]{39,59}"),
    ("dogecoin", "[D][5-9A-HJ-NP-U][1-9A-HJ-NP-Za-km-z]{32}"),
    ("dogecoin-alt", "[A][5-9A-HJ-NP-U][1-9A-HJ-NP-Za-km-z]{32}"),
    ("ripple-classic", "r[1-9A-HJ-NP-Za-km-z]{25,34}"),
    ("ripple-x", "X[1-9A-HJ-NP-Za-km-z]{46}"),
    ("cardano-shelley", "addr1[a-z0-9]{58,}"),
    ("cardano-byron", "Ae2[a-km-zA-HJ-NP-Z1-9]{93,}"),
    ("monero", "[48][0-9AB][1-9A-HJ-NP-Za-km-z]{93}"),
    ("monero-sub", "[8][0-9AB][1-9A-HJ-NP-Za-km-z]{93}"),
    ("monero-integrated", "[4][0-9AB][1-9A-HJ-NP-Za-km-z]{105}"),
    ("stellar", "G[A-Z2-7]{55}"),
    ("tron", "T[1-9A-HJ-NP-Za-km-z]{33}"),
    ("eos", "[a-z1-5\\.]{1,12}"),
    ("polkadot", "[1-9A-HJ-NP-Za-km-z]{47,48}"),
    ("solana", "[1-9A-HJ-NP-Za-km-z]{32,44}"),
    ("binance", "bnb1[a-z0-9]{38}"),
    ("cosmos", "cosmos1[a-z0-9]{38}"),
    ("tezos-tz1", "tz1[1-9A-HJ-NP-Za-km-z]{33}"),
    ("tezos-tz2", "tz2[1-9A-HJ-NP-Za-km-z]{33}"),
    ("tezos-tz3", "tz3[1-9A-HJ-NP-Za-km-z]{33}"),
    ("zcash-taddr", "t[13][a-km-zA-HJ-NP-Z1-9]{33}"),
    ("zcash-zaddr", "zs1[a-z0-9]{75}"),
    ("dash", "X[1-9A-HJ-NP-Za-km-z]{33}"),
    ("neo", "A[0-9a-zA-Z]{33}"),
    ("algorand", "[A-Z2-7]{58}"),
    ("avalanche-x", "X-[a-zA-Z0-9]{39}"),
    ("avalanche-c", "0x[a-fA-F0-9]{40}"),
    ("hedera", "0\\.0\\.[0-9]+"),
    ("iota", "[A-Z9]{90}"),
    ("vechain", "0x[a-fA-F0-9]{40}"),
    ("filecoin-f1", "f1[a-z0-9]{38,}"),
    ("filecoin-f3", "f3[a-z0-9]{38,}"),
    ("near", "[a-z0-9_\\-\\.]{2,64}\\.near"),
    ("kusama", "[C-H][1-9A-HJ-NP-Za-km-z]{46,47}"),
    ("elrond", "erd1[a-z0-9]{58}"),
    ("fantom", "0x[a-fA-F0-9]{40}"),
    ("polygon", "0x[a-fA-F0-9]{40}"),
    ("bch-legacy", "[13][a-km-zA-HJ-NP-Z1-9]{25,34}"),
    ("bch-cashaddr", "((bitcoincash|bchreg|bchtest):)?[qp][a-z0-9]{41}"),
)
CRYPTO = tuple(n for n, _ in DIGEST_LENGTHS) + tuple(n for n, _ in ADDRESS_FORMS)

# Lengths that speak for a digest or an address.
HASH_LENGTHS = (32, 40, 56, 64, 96, 128, 34, 42, 62, 66)

# Index field types, in order, and the order in which one of several is chosen (IP is put after GEO_POINT).
FIELD_TYPES = "TEXT KEYWORD BYTE SHORT INTEGER LONG FLOAT DOUBLE BOOLEAN OBJECT NESTED IP GEO_POINT BINARY DATE WILDCARD TEXT_WITH_KEYWORD UNKNOWN".split()
TYPE_PRIORITY = "DATE GEO_POINT IP BOOLEAN DOUBLE FLOAT LONG INTEGER TEXT_WITH_KEYWORD WILDCARD TEXT KEYWORD UNKNOWN".split()

# Own categories and their field types.
CUSTOM = {"index": "INTEGER", "job-title": "TEXT", "gender": "KEYWORD", "hash": "KEYWORD", "id": "KEYWORD"}

# Kinds of personal data and their field types; the last three are known but never detected.
PII_TYPES = {
    "email-address": "KEYWORD", "phone-number": "KEYWORD", "ssn": "KEYWORD", "credit-card": "KEYWORD", "ip-address": "IP", "date": "DATE", "url": "KEYWORD",
    "age": "TEXT", "bank-routing-number": "INTEGER", "bitcoin-address": "KEYWORD", "drivers-license": "UNKNOWN", "iban-code": "KEYWORD", "mac-address": "KEYWORD",
    "passport-number": "KEYWORD", "vin": "KEYWORD", "currency": "KEYWORD", "tracking-number": "KEYWORD", "state-abbreviation": "TEXT", "city": "TEXT",
    "county": "TEXT", "state": "TEXT", "hospital": "TEXT", "zip-code": "KEYWORD", "phone-number-extension": "KEYWORD", "street-address": "GEO_POINT",
    "first-name": "KEYWORD", "surname": "KEYWORD", "physician-name": "TEXT", "section": "KEYWORD", "person": "TEXT", "hospital-abbreviation": "TEXT",
}

#: Every category, and the field type of each.
CATEGORY_TYPES = PII_TYPES | {n: "KEYWORD" for n in CRYPTO} | CUSTOM
CATEGORIES = tuple(PII_TYPES) + CRYPTO + tuple(CUSTOM)

# Keys of metadata in a file name, with the field each fills.
FILE_KEYS = {
    "loader": "loader", "total_rows": "total_rows", "id_column_name": "id_column_name", "elastic_index_name": "elastic_index_name",
    "elastic_shards": "number_of_shards", "elastic_replicas": "number_of_replicas", "case_id": "case_id", "md5": "md5",
    "display_name": "display_name", "display_section": "section",
}

STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware",
    "DC": "District of Columbia", "FL": "Florida", "GA": "Georgia", "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa",
    "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland", "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota",
    "MS": "Mississippi", "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire", "NJ": "New Jersey",
    "NM": "New Mexico", "NY": "New York", "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon",
    "PA": "Pennsylvania", "RI": "Rhode Island", "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas", "UT": "Utah",
    "VT": "Vermont", "VA": "Virginia", "WA": "Washington", "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming",
}
