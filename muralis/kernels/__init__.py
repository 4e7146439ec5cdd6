"""Numpy kernels on single images; ``muralis.operators.vision`` runs them over tables of images."""
