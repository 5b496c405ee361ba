"""Assembly of prompts and resolution of a user's preferences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlight.functions.text import is_blank, java_trim

# Defaults of a preference row.
PREFERENCE_DEFAULTS = {
    "theme": "light",
    "language": "en",
    "citation_enabled": True,
    "response_style": "BEGINNER",
    "model_name": "GEMINI_3_1_FLASH_LITE",
    "temperature": 0.7,
}

# Model names and the strings they are requested by.
MODELS = {
    "GEMINI_2_5_FLASH": "gemini-2.5-flash",
    "GEMINI_2_5_FLASH_LITE": "gemini-2.5-flash-lite",
    "GEMINI_2_5_PRO": "gemini-2.5-pro",
    "GEMINI_2_5_PRO_LITE": "gemini-2.5-pro-lite",
    "GEMINI_3_1_FLASH_LITE": "gemini-3.1-flash-lite",
}

# Response styles, in the words appended to a prompt.
STYLES = {
    "TECHNICAL": "Provide a highly technical, precise, and professional response, using appropriate terminology.",
    "CONCISE": "Provide a brief, direct, and concise response without fluff or unnecessary details.",
    "DETAILED": "Provide an in-depth, thorough, and highly detailed response, exploring all relevant aspects.",
    "BEGINNER": "Explain the concepts simply, as if speaking to a beginner, avoiding overly complex jargon.",
}

# Answer languages and their aliases; anything else is English.
LANGUAGES = {
    "hi": "Hindi (हिंदी)",
    "hindi": "Hindi (हिंदी)",
    "te": "Telugu (తెలుగు)",
    "telugu": "Telugu (తెలుగు)",
    "es": "Spanish (Español)",
    "spanish": "Spanish (Español)",
    "fr": "French (Français)",
    "french": "French (Français)",
    "de": "German (Deutsch)",
    "german": "German (Deutsch)",
}
INSTRUCTION = "\n\nCRITICAL INSTRUCTION: "
REFUSAL_EXAMPLE = "I couldn't find relevant information in the uploaded documents."

# What the grounded prompt says about inference, by strategy.
LITERAL_DIRECTIVE = (
    "Be literal. Extrapolate nothing. If the exact phrase or fact is missing, "
    "state that it is not present."
)
DIRECTIVES = {
    "CONCEPT_EXPANSION": (
        "Never say a concept is absent because the exact word is missing. "
        "Infer the concept from the underlying evidence present in the retrieved context. "
        "Map thematic evidence to the abstract concept the user asked about and answer accordingly."
    ),
}
# Not fixed: what a search for documents is told; callers pass their own.
DOCUMENT_SEARCH_DIRECTIVE = (
    "Say which documents answer the question and name each of them. "
    "Judge by theme, not by exact wording."
)
DIRECTIVE_SLOT = "<inferenceDirective>"


def lookup(values: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(part) for item in values.items() for part in item]
    return F.create_map(*pairs)[key]


def history_line(role: Column, content: Column) -> Column:
    speaker = F.when(role == "USER", "User").otherwise("Assistant")
    return F.concat(speaker, F.lit(": "), content)


def session_block(files: Column, active_file: Column) -> Column:
    """The uploaded files of a session, one per line, and the active one."""
    listed = F.concat(
        F.lit("Runtime Session Context:\nUploaded Files:\n- "),
        F.array_join(files, "\n- "),
        F.lit("\n"),
    )
    active = F.concat(F.lit("Currently Active File in UI: "), active_file, F.lit("\n"))
    block = F.concat(listed, F.coalesce(active, F.lit("")))
    return F.when(F.size(files) > 0, block).otherwise("")


def user_prompt(question: Column, context: Column, history: Column, session: Column) -> Column:
    return F.concat(
        F.lit("Context Information:\n"),
        context,
        F.lit("\n\n"),
        session,
        F.lit("\nConversation History:\n"),
        history,
        F.lit("\n\nUser Question:\n"),
        question,
    )


def system_prompt(
    no_evidence: Column,
    strategy: Column,
    history: Column,
    grounded: str,
    general: str,
    document_search: str = DOCUMENT_SEARCH_DIRECTIVE,
) -> Column:
    """The grounded prompt with its directive; the general one without evidence and history."""
    known = {**DIRECTIVES, "META_DOC_SEARCH": document_search}
    directive = F.coalesce(lookup(known, strategy), F.lit(LITERAL_DIRECTIVE))
    filled = F.replace(F.lit(grounded), F.lit(DIRECTIVE_SLOT), directive)
    return F.when(no_evidence & is_blank(history), F.lit(general)).otherwise(filled)


def requested_model(override: Column, preferred: Column) -> Column:
    """A valid override wins, then the preference; null leaves the choice to the caller."""
    known = lookup(MODELS, override)
    return F.coalesce(F.when(~is_blank(override), known), lookup(MODELS, preferred))


def language_name(language: Column) -> Column:
    return F.coalesce(lookup(LANGUAGES, java_trim(F.lower(language))), F.lit("English"))


def styled_prompt(prompt: Column, style: Column, language: Column) -> Column:
    """The prompt followed by the style and language instructions of the user."""
    name = language_name(language)
    told = F.concat(F.lit(INSTRUCTION), lookup(STYLES, style))
    translated = F.concat(
        F.lit(INSTRUCTION + "You MUST respond entirely in "),
        name,
        F.lit(
            ". Do not respond in English. Translate all context, output, and fallback/error "
            f"messages (such as '{REFUSAL_EXAMPLE}') into "
        ),
        name,
        F.lit(
            " before outputting. Do not respond in any other language under any circumstances."
        ),
    )
    foreign = ~is_blank(language) & (name != "English")
    return F.concat(
        prompt,
        F.coalesce(told, F.lit("")),
        F.when(foreign, translated).otherwise(""),
    )


def with_preference_defaults(preferences: DataFrame) -> DataFrame:
    filled = {
        name: F.coalesce(F.col(name), F.lit(value))
        for name, value in PREFERENCE_DEFAULTS.items()
        if name in preferences.columns
    }
    return preferences.withColumns(filled)


def update_preferences(preferences: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply partial updates by user; nulls and unknown names leave the stored value.

    Users without a stored row start from the defaults.
    """
    valid = changes.select(
        "user_id",
        F.col("theme").alias("_theme"),
        F.col("language").alias("_language"),
        F.col("citation_enabled").alias("_citation_enabled"),
        F.when(F.upper("response_style").isin(list(STYLES)), F.upper("response_style")).alias(
            "_response_style"
        ),
        F.when(F.upper("model_name").isin(list(MODELS)), F.upper("model_name")).alias(
            "_model_name"
        ),
        F.col("temperature").alias("_temperature"),
    )
    merged = preferences.join(valid, "user_id", "full_outer")
    return merged.select(
        "user_id",
        *[
            F.coalesce(F.col(f"_{name}"), F.col(name), F.lit(value)).alias(name)
            for name, value in PREFERENCE_DEFAULTS.items()
        ],
    )
