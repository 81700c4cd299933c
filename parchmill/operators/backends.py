"""Back ends that need packages or services from outside, each behind an import that names
what to install. ``register()`` puts them into the registries; nothing is imported until a
worker first uses one, and each is loaded once in a task.
"""

from __future__ import annotations

import glob
import importlib
import os
import time
from collections.abc import Callable

import numpy as np

from ..plans.config import PROFILES
from . import embed, generate, language

#: Model names, by use.
EMBEDDING_MODELS = ("sentence-transformers/paraphrase-multilingual-MiniLM-L12-v2", "intfloat/multilingual-e5-large")
READER_MODEL, OPENAI_MODEL, GEMINI_MODEL = "google/flan-t5-large", "gpt-4o-mini", "gemini-3.5-flash"
GEMINI_SECONDS, GOOGLE_CHARS = 30.0, 1000
TRANSLATION_CODES = {"en": "eng_Latn", "ta": "tam_Taml", "hi": "hin_Deva"}


def need(module: str, package: str | None = None):
    """The module, or an ImportError that says how to get it."""
    try:
        return importlib.import_module(module)
    except ImportError as e:
        raise ImportError(f"{module} is not installed: pip install {package or module}") from e


def with_retries(call: Callable, attempts: int = 3, pause: float = 1.0, backoff: float = 3.0, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """``call`` spaced by ``pause`` seconds, tried again after ``backoff``; a ValueError with
    the last cause when all attempts fail."""

    def run(*args):
        for i in range(attempts):
            try:
                sleep(pause)
                return call(*args)
            except Exception as e:
                cause = e
                if i + 1 < attempts:
                    sleep(backoff)
        raise ValueError(f"failed after {attempts} attempts: {cause}") from cause

    return run


# ---- OCR: from an image to (text, confidence in percent)


def tesseract(languages: str = PROFILES["module"].tesseract_languages):
    t = need("pytesseract")

    def read(image) -> tuple[str, float]:
        d = t.image_to_data(image, lang=languages, output_type=t.Output.DICT)
        rated = [(w, float(c)) for w, c in zip(d["text"], d["conf"]) if float(c) >= 0]
        return " ".join(w for w, _ in rated if w.strip()), float(np.mean([c for _, c in rated])) if rated else 0.0

    return read


_EASYOCR: dict[tuple[str, str | None], object] = {}


def _easyocr_reader(code: str, models: str | None):
    """The reader of a language, kept for the process. Where it cannot be made, its stored
    model files are taken for broken: they are removed and it is made anew once; English is
    the last resort."""
    if (code, models) not in _EASYOCR:
        e = need("easyocr")
        make = lambda c: e.Reader(["en"] if c == "en" else ["en", c], **({"model_storage_directory": models} if models else {}))
        try:
            reader = make(code)
        except Exception:
            broken = [p for n in (code, "tamil") for p in glob.glob(os.path.join(models, f"{n}*"))] if models else []
            for p in broken:
                os.remove(p)
            try:
                reader = make(code) if broken else None
            except Exception:
                reader = None
            reader = reader or (_easyocr_reader("en", models) if code != "en" else make("en"))
        _EASYOCR[code, models] = reader
    return _EASYOCR[code, models]


def easyocr(language_code: str = "ta", models: str | None = None):
    reader = _easyocr_reader(language_code, models)

    def read(image) -> tuple[str, float]:
        found = [(x[1], x[2] if len(x) > 2 else 1.0) for x in reader.readtext(np.asarray(image))]
        return "\n".join(t for t, _ in found), float(np.mean([c * 100 for _, c in found])) if found else 0.0

    return read


def page_images(read: Callable, dpi: int = 300) -> Callable:
    """An OCR engine for pages of a PDF; only the page asked for is rasterised."""
    return lambda page: read(page.to_image(resolution=dpi).original)


OCR_ENGINES: dict[str, Callable] = {"tesseract": tesseract, "easyocr": easyocr}

# ---- language


def statistical_detector(supported: tuple[str, ...] = ("en", "ta", "hi")) -> Callable[[list[str]], list[str]]:
    """langdetect with a fixed seed, langid where it fails, English for what is unsupported."""
    d = need("langdetect")
    d.DetectorFactory.seed = 42

    def one(text: str | None) -> str:
        if not text or not text.strip():
            return "en"
        try:
            code = d.detect(text)
        except Exception:
            code = need("langid").classify(text)[0]
        return code if code in supported else "en"

    return lambda texts: [one(t) for t in texts]


def google():
    """The public web service, one piece at a time; an empty result leaves the piece."""
    t = need("deep_translator", "deep-translator").GoogleTranslator
    call = with_retries(lambda p, a, b: t(source=a, target=b).translate(p))
    return lambda pieces, source, target: [call(p, source, target) or p for p in pieces]


def indictrans():
    torch, tr, kit = need("torch"), need("transformers"), need("IndicTransToolkit")
    loaded: dict[bool, tuple] = {}

    def run(pieces: list[str], source: str, target: str) -> list[str]:
        away = source == "en"
        if away not in loaded:
            name = f"ai4bharat/indictrans2-{'en-indic' if away else 'indic-en'}-dist-200M"
            loaded[away] = tr.AutoTokenizer.from_pretrained(name, trust_remote_code=True), tr.AutoModelForSeq2SeqLM.from_pretrained(name, trust_remote_code=True), kit.IndicProcessor(inference=True)
        tokens, model, prepare = loaded[away]
        a, b = TRANSLATION_CODES[source], TRANSLATION_CODES[target]
        batch = tokens(prepare.preprocess_batch(pieces, src_lang=a, tgt_lang=b), padding=True, truncation=True, return_tensors="pt")
        with torch.no_grad():
            out = model.generate(**batch, max_length=256, num_beams=5)
        return prepare.postprocess_batch(tokens.batch_decode(out, skip_special_tokens=True), lang=b)

    return run


# ---- embeddings


def sentence_transformer(_dimensions: int):
    st = need("sentence_transformers", "sentence-transformers")
    model = cause = None
    for name in EMBEDDING_MODELS:
        try:
            model = st.SentenceTransformer(name)
            break
        except Exception as e:
            cause = e
    if model is None:
        raise RuntimeError("no embedding model could be loaded") from cause
    return lambda texts: model.encode(texts, batch_size=16, normalize_embeddings=True, convert_to_numpy=True).astype(np.float32)


# ---- readers


def local_reader():
    tr = need("transformers")
    tokens, model = tr.AutoTokenizer.from_pretrained(READER_MODEL), tr.AutoModelForSeq2SeqLM.from_pretrained(READER_MODEL)

    def read(system: str, prompt: str, question: str, context: str) -> str:
        x = tokens(f"{system}\n\n{prompt}", return_tensors="pt", truncation=True)
        out = model.generate(**x, max_new_tokens=512, do_sample=False, num_beams=3, repetition_penalty=1.1, no_repeat_ngram_size=5, early_stopping=True)
        return tokens.decode(out[0], skip_special_tokens=True)

    return read


def _key(name: str) -> str:
    if not os.environ.get(name):
        raise ValueError(f"set {name} to use this reader")
    return os.environ[name]


def openai_reader():
    client = need("openai").OpenAI(api_key=_key("OPENAI_API_KEY"))

    def read(system: str, prompt: str, question: str, context: str) -> str:
        messages = [{"role": "system", "content": system}, {"role": "user", "content": prompt}]
        return client.chat.completions.create(model=OPENAI_MODEL, messages=messages, max_tokens=512, temperature=0.0).choices[0].message.content

    return read


def gemini_reader():
    client = need("google.genai", "google-genai").Client(api_key=_key("GEMINI_API_KEY"), http_options={"timeout": GEMINI_SECONDS})

    def read(system: str, prompt: str, question: str, context: str) -> str:
        try:
            return client.models.generate_content(model=GEMINI_MODEL, contents=prompt, config={"system_instruction": system, "temperature": 0.0, "max_output_tokens": 512}).text
        except Exception as e:
            s = str(e).lower()
            kind = "invalid key" if "api key" in s or "api_key" in s or "401" in s else f"timeout after {GEMINI_SECONDS:.0f} s" if "timeout" in s or "timed out" in s or "deadline" in s else "error"
            raise RuntimeError(f"{kind}: {e}") from e

    return read


def register() -> None:
    language.TRANSLATORS.update(googletrans=google, indictrans2=indictrans)
    language.MOST_CHARS.update(googletrans=GOOGLE_CHARS)
    language.DETECTORS.update(langdetect=statistical_detector)
    embed.EMBEDDERS.update(sentence_transformers=sentence_transformer)
    generate.READERS.update(huggingface=local_reader, openai=openai_reader, google=gemini_reader)
