"""Readers and writers of documents, source trees and artifacts."""
