"""A collection of three invented documents and questions on it."""

DOCUMENTS = [
    (1, "harbour", "Harbour pilots guide cargo vessels through narrow channels using tide tables and radio beacons."),
    (2, "orchard", "Orchard keepers prune apple trees in winter. Pruning should remove crossing branches before sap rises."),
    (3, "archive", "Archive clerks catalogue letters, maps and photographs with stable shelf marks and condition notes."),
]
#: Number, question, and the document that answers it.
QUESTIONS = [(1, "How do pilots guide vessels?", 1), (2, "When are apple trees pruned?", 2), (3, "Which notes describe the condition of maps?", 3), (4, "Who remembers the orchestra?", 1)]
