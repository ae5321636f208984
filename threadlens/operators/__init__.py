"""DataFrame operators: threads, sampling, annotation, evaluation, analysis,
opportunities, marts, features and the detector."""
