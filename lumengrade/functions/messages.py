"""Warning classes and reader-friendly review reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code -> (stage, message).
WARNING_CODES = {
    "PDF_RENDER_FAILED": ("student_detection", "Não foi possível converter o PDF em imagens."),
    "QR_READ_FAILED": ("qr_reading", "O QR Code não pôde ser lido em uma ou mais páginas."),
    "TRANSCRIPTION_FAILED": ("transcription", "Falha na transcrição visual de uma resposta manuscrita."),
    "GRADING_FAILED": ("grading", "Falha na correção automática de uma ou mais respostas."),
    "JSON_SCHEMA_INVALID": ("grading", "A IA retornou uma resposta fora do formato esperado."),
    "RUBRIC_MISMATCH": ("grading", "A rubrica da questão não corresponde à questão detectada."),
    "DATABASE_ERROR": ("database", "Erro ao salvar os resultados no banco."),
    "PDF_ANALYSIS_FAILED": ("unknown", "Não foi possível analisar o PDF."),
}


def _has(text: Column, *words: str) -> Column:
    found = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        found = found | F.contains(text, F.lit(w))
    return found


def warning_code(text: Column) -> Column:
    """The class of a warning text; texts of neither failure nor JSON are weak student links."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(~_has(t, "falha", "json"), "STUDENT_LINK_WEAK")
        .when(_has(t, "rubrica") & _has(t, "troca"), "RUBRIC_MISMATCH")
        .when(_has(t, "json") & _has(t, "schema", "incompleto", "invalid"), "JSON_SCHEMA_INVALID")
        .when(_has(t, "render") | (_has(t, "pdf") & _has(t, "imagem")), "PDF_RENDER_FAILED")
        .when(_has(t, "qr"), "QR_READ_FAILED").when(_has(t, "transcri"), "TRANSCRIPTION_FAILED")
        .when(_has(t, "grading", "corre"), "GRADING_FAILED").when(_has(t, "database", "sql", "psycopg"), "DATABASE_ERROR")
        .otherwise("PDF_ANALYSIS_FAILED")
    )


def warning_stage(code: Column) -> Column:
    out = F.lit("unknown")
    for name, (stage, _) in WARNING_CODES.items():
        out = F.when(code == name, stage).otherwise(out)
    return out


def warning_message(code: Column, text: Column) -> Column:
    out = text
    for name, (_, said) in WARNING_CODES.items():
        out = F.when(code == name, said).otherwise(out)
    return out


def friendly_reason(warnings: Column, error: Column, empty: Column, low: Column) -> Column:
    """One readable sentence for all that speaks for review; '' where nothing does."""
    t = F.lower(F.concat_ws(" | ", F.coalesce(warnings, F.array().cast("array<string>")), F.array(F.coalesce(error, F.lit("")))))
    return (
        F.when(empty | _has(t, "sem resposta", "resposta vazia"), "Resposta em branco ou não detectada.")
        .when(_has(t, "cópia do enunciado", "copia do enunciado"), "Resposta parece cópia do enunciado da questão.")
        .when(_has(t, "schema incompleto", "json"), "Falha no formato da resposta da IA. Conferir nota sugerida.")
        .when(_has(t, "expecting property name"), "Falha ao interpretar resposta da IA. Revisão manual recomendada.")
        .when(_has(t, "identity_source", "manifest_fallback", "sem qr confiável"), "Vinculação do aluno feita sem QR confiável. Conferir aluno.")
        .when(low | _has(t, "baixa confiança"), "Baixa confiança na leitura da resposta manuscrita.")
        .when(_has(t, "off-topic", "fora do tema"), "Resposta fora do tema da questão.")
        .when(F.regexp_replace(t, r"\s", "") != "", "Revisão manual recomendada.").otherwise("")
    )
