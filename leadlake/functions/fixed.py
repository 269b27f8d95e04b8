"""They must equal the documented business rules exactly."""

# Keywords that mark an inbound message as an opt-out request.
OPT_OUT_KEYWORDS = [
    "STOP", "SAIR", "PARAR", "SAIA", "PARE", "NAO QUERO", "NAO QUERO RECEBER",
    "CANCELAR", "CANCELA", "REMOVER", "DESCADASTRAR", "DESINSCREVER", "OPT OUT", "OPTOUT",
]

# Consumer mail providers that do not count as corporate domains.
FREE_EMAIL_DOMAINS = [
    "gmail.com", "googlemail.com",
    "outlook.com", "outlook.com.br", "hotmail.com", "hotmail.com.br", "live.com", "msn.com", "windowslive.com",
    "yahoo.com", "yahoo.com.br", "ymail.com", "rocketmail.com", "aol.com", "verizon.net",
    "icloud.com", "me.com", "mac.com",
    "protonmail.com", "protonmail.ch", "proton.me", "pm.me",
    "tutanota.com", "tutanota.de", "tutamail.com", "tuta.io", "keemail.me",
    "fastmail.com", "fastmail.fm", "fastmail.net", "zoho.com", "zohomail.com", "zohomail.eu",
    "gmx.com", "gmx.net", "gmx.de", "mail.com", "email.com", "inbox.com",
    "mail.ru", "bk.ru", "list.ru", "inbox.ru", "internet.ru",
    "yandex.com", "yandex.ru", "ya.ru",
    "qq.com", "163.com", "126.com", "sina.com", "sina.cn", "yeah.net",
    "uol.com.br", "bol.com.br", "terra.com.br", "ig.com.br", "globo.com", "oi.com.br", "r7.com",
    "zipmail.com.br", "itelefonica.com.br", "click21.com.br", "pop.com.br", "ibest.com.br",
]

# Funnel stages in display order: status -> (label, pipeline weight in percent).
STAGES = {
    "qualified": ("Pronto para contato", 72),
    "prospect": ("Lead", 38),
    "lead": ("Nova oportunidade", 18),
    "contacted": ("Contato iniciado", 48),
    "proposal": ("Proposta enviada", 82),
    "closed": ("Cliente ganho", 100),
}
BASE_STAGES = ["qualified", "prospect", "lead"]
UNKNOWN_STAGE_WEIGHT = 38

# Stage labels used by the opportunities export.
EXPORT_STAGE_LABELS = {
    "all": "Todas", "qualified": "Prontas para contato", "prospect": "Em avaliação",
    "lead": "Novas oportunidades", "contacted": "Contato iniciado",
    "proposal": "Proposta enviada", "closed": "Cliente ganho",
}

KANBAN_COLUMNS = ["lead", "prospect", "qualified", "closed"]
UNCLASSIFIED = "Não classificado"

# Contact and firmographic fields withheld from tenants without the premium plan.
RESTRICTED_FIELDS = [
    "cnpj_email", "email", "cnpj_phones", "phones", "cnpj_partners", "partners",
    "cnpj_opened_at", "opened_at", "cnpj_legal_nature", "legal_nature", "cnpj_raw_data",
]
TRIAL_LEAD_LIMIT = 10

# Provider vocabularies -> ours.
SESSION_STATUS = {
    "WORKING": "CONNECTED", "CONNECTED": "CONNECTED", "STARTING": "STARTING",
    "SCAN_QR_CODE": "QR_REQUIRED", "QRCODE": "QR_REQUIRED", "QR_REQUIRED": "QR_REQUIRED",
    "STOPPED": "STOPPED", "DISCONNECTED": "DISCONNECTED", "FAILED": "ERROR", "ERROR": "ERROR",
}
MEDIA_TYPE = {
    "IMAGE": "IMAGE", "DOCUMENT": "DOCUMENT", "FILE": "DOCUMENT", "AUDIO": "AUDIO",
    "PTT": "AUDIO", "VOICE": "AUDIO", "VIDEO": "VIDEO", "LOCATION": "LOCATION",
}
REGISTRATION_STATUS = {
    "ATIVA": "ATIVA", "ATIVO": "ATIVA", "ACTIVE": "ATIVA",
    "BAIXADA": "BAIXADA", "INATIVO": "BAIXADA", "INACTIVE": "BAIXADA",
    "CANCELADA": "BAIXADA", "SUSPENSA": "BAIXADA", "NULA": "BAIXADA",
}
ACTIVE_REGISTRATIONS = ["ATIVA", "ATIVO", "ACTIVE"]
TECH_SEGMENTS = ["Software", "Technology", "SaaS", "Fintech"]

# Namespace of the name-based company identifiers.
COMPANY_ID_NAMESPACE = "6f4c1a2e-9b7d-4e3a-8c5f-1d2e3a4b5c6d"

# Accented letters and their plain forms, both cases.
ACCENTED = "ÁÀÂÃÄÅáàâãäåÉÈÊËéèêëÍÌÎÏíìîïÓÒÔÕÖóòôõöÚÙÛÜúùûüÇçÑñÝýÿ"
UNACCENTED = "AAAAAAaaaaaaEEEEeeeeIIIIiiiiOOOOOoooooUUUUuuuuCcNnYyy"

TERMINAL_OUTREACH = ["REPLIED", "UNSUBSCRIBED", "CANCELLED"]
TERMINAL_SEQUENCE = ["REPLIED", "OPTED_OUT", "CANCELLED", "COMPLETED"]
ACTIVE_SEQUENCE = ["QUEUED", "SENDING", "SENT"]
OPENABLE = ["SENT", "SCHEDULED", "DELIVERED_INFERRED", "OPENED_INFERRED"]
FOLLOWUP_DAYS = [3, 5, 7]
MAX_EMAILS = 4

# Texts of the outreach e-mail.
MAIL_SUBJECT = "Uma oportunidade para "
MAIL_GREETING = "Olá,"
MAIL_HOPE = "Espero que esteja bem!"
MAIL_KNOWN = "Conheço a "
MAIL_SEGMENT = " e sei que empresas do segmento "
MAIL_NO_SEGMENT = "de negócios"
MAIL_CLAIM = " costumam enfrentar desafios na identificação de oportunidades."
MAIL_HELP = "Nossa plataforma de inteligência de dados ajuda times comerciais a "
MAIL_PROPOSITION = "encontrar e qualificar leads com mais eficiência"
MAIL_ASK = "Gostaria de agendar uma conversa rápida de 15 min para apresentar como funciona?"
MAIL_CLOSE, MAIL_CLOSE_HTML = "Abs.,", "Abraços,"
MAIL_SENDER = "Equipe comercial"
MAIL_FACTS = ["Referência a ", "Segmento: ", "geral"]
