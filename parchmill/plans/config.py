"""Engine settings. Two profiles exist; ``module`` is the default."""

from __future__ import annotations

from dataclasses import dataclass, replace

#: The texts that readers get and that stands for no answer.
NOT_FOUND = "Information not found in the uploaded document."

SYSTEM_PROMPT = (
    "You are a strict legal document assistant. "
    "Answer ONLY using information from the provided document excerpts. "
    "Format your answer clearly: use numbered points or short paragraphs (one idea per line). "
    "Each line or point must be a complete, readable sentence. Do NOT merge everything into a single dense block of text. "
    "If the user asks for a summary, provide a detailed summary of exactly between 7 and 10 lines — no fewer than 7, no more than 10. "
    "Each line of the summary must contain one clear, standalone point from the document. "
    "If the answer is not present in the excerpts, respond exactly with: "
    "'Information not found in the uploaded document.' "
    "Do NOT use any external knowledge. Do NOT hallucinate."
)
USER_PROMPT = "Document Excerpts:\n{context}\n\nQuestion: {question}\n\nAnswer (cite the section/clause/GO number if mentioned; use clear numbered points):"


@dataclass(frozen=True)
class Config:
    languages: tuple[str, ...] = ("en", "ta", "hi")
    extensions: tuple[str, ...] = (".pdf", ".txt", ".docx")
    min_page_chars: int = 30
    translate_max_chars: int = 2000
    chunk_max: int = 400
    chunk_min: int = 50
    chunk_overlap: int = 50
    top_k: int = 5
    min_score: float = 0.30
    index_type: str = "flat_ip"
    min_overlap: float = 0.40
    min_entities: float = 0.5
    min_sentences: float = 0.5
    sentence_overlap: float = 0.4
    min_confidence: float = 40.0
    bonus_above: float = 0.80
    bonus: float = 5.0
    summary_factor_k: int = 2
    summary_least_k: int = 16
    summary_factor_score: float = 0.5
    retry_more_k: int = 3
    retry_factor_score: float = 0.6
    embedder: str = "hashing"
    translator: str = "identity"
    detector: str = "script"
    reader: str = "extractive"
    ocr: str = "none"
    tesseract_languages: str = "eng+tam+hin"
    dimensions: int = 384
    batch: int = 16


PROFILES = {"module": Config(), "notebook": replace(Config(), top_k=8, min_score=-1.0)}
