"""Concepts: synonyms of terms, and markers that place a tag under concepts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Terms and what they are called here.
SYNONYMS = {
    "qft": "quantum field theory", "quantum field theories": "quantum field theory", "scattering amplitude": "scattering amplitudes",
    "amplitude": "scattering amplitudes", "bcfw": "bcfw recursion", "bcfw shift": "bcfw recursion", "britto-cachazo-feng-witten": "bcfw recursion",
    "nlsm": "non-linear sigma model", "yang-mills": "yang-mills theory", "ym": "yang-mills theory", "feynman diagram": "feynman diagrams",
    "color-kinematic duality": "bcj duality", "bern-carrasco-johansson": "bcj duality", "alg geom": "algebraic geometry",
    "algebraic geom": "algebraic geometry", "sheaf": "sheaves", "scheme": "schemes", "variety": "algebraic varieties", "varieties": "algebraic varieties",
}

#: Concepts and the markers that place a tag under them.
CONCEPTS = {
    "hidden_zeros": ["hidden_zero", "hidden_zeroes", "amplitude_zero", "amplitude_zeros", "tr_phi3_zero", "phi3_zero", "ym_zero", "gluon_zero", "massless_zero", "general_zero", "novel_zero", "amplitude_vanishing", "zero_locus", "zero_condition", "zeros_factorization", "zeros_factorisation", "zero_causal_diamond", "string_amplitude_zero", "zeros_factorizations", "skinny_rectangle_zero"],
    "splitting": ["splitting", "splittings", "smooth_split", "amplitude_split", "phi3_split", "ym_split", "tensor_split", "vertex_split", "factorization_3_split"],
    "factorization": ["factorization", "factorisation", "factorizations", "amplitude_factor", "propagator_factor", "recursive_factor", "gluon_factor", "tr_phi3_factor", "stringy_factor", "factorization_proof", "factorization_pattern", "factorization_mechanism", "factorization_example", "causal_diamond_factor", "numerator_factor"],
    "kinematic_mesh": ["kinematic_mesh", "mesh_picture", "mesh_structure", "mesh_region", "gluon_mesh", "simplices_mesh", "scattering_mesh", "effective_gluon_kinematic_mesh", "massive_kinematic_mesh", "kinematic_mesh_example"],
    "abhy_associahedron": ["abhy_associahedron", "associahedron"],
    "nlsm": ["nlsm", "mnlsm", "pion_amplitude", "pion_soft", "non_linear_sigma", "nonlinear_sigma"],
    "tr_phi3": ["tr_phi3", "tr_phi_amplitude", "tr_phi_3", "phi3_amplitude", "phi3_theory", "phi3_currents"],
    "yang_mills": ["yang_mills", "ym_amplitude", "ym_amplitudes", "ym_hidden", "ym_constraints", "gluon_amplitude", "n_gluon", "n_point_gluon"],
    "string_amplitude": ["string_amplitude", "stringy_integral", "stringy_deformation", "stringy_generalization", "bosonic_string", "stringy_factorization", "stringy_uv", "stringy_tr_phi", "stringy_formulation"],
    "uv_scaling": ["uv_scaling", "uv_completion", "uv_behaviour", "uv_softening", "uv_amplitude", "uv_power", "enhanced_uv", "ultraviolet_scaling"],
    "bcfw": ["bcfw", "britto", "cachazo", "feng", "witten", "britto_cachazo_feng_witten", "britto-cachazo-feng-witten"],
    "adler_zero": ["adler_zero", "adler_limit"],
    "uniqueness_conjecture": ["uniqueness", "unique_amplitude", "tr_phi3_conjecture", "phi3_conjecture", "amplitude_determination", "amplitude_uniqueness", "uniqueness_proof", "uniqueness_theorem", "uniqueness_conjecture", "uniqueness_results", "conjecture", "ansatz", "scattering_amplitudes_proof"],
    "soft_theorem": ["soft_theorem", "soft_limit", "soft_limits", "soft_recursion"],
    "causal_diamond": ["causal_diamond"],
    "kinematic_shift": ["kinematic_shift", "kinematical_shift", "triangulation_shift"],
    "scaffolding": ["scaffolding"],
    "planar_variables": ["planar_variable", "planar_variables", "mandelstam", "kinematic_invariant", "kinematic_basis", "kinematic_data"],
    "discovery": ["discovery", "first_observation", "first_seen", "introduction", "discovered_in"],
}


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def normal_term(term: Column) -> Column:
    """A term's synonym, or itself in lower case without outer spaces."""
    t = F.lower(F.regexp_replace(term, r"^\s+|\s+$", ""))
    return F.coalesce(F.try_element_at(_map(SYNONYMS), t), t)


def normal_terms(terms: Column) -> Column:
    return F.filter(F.array_distinct(F.transform(terms, normal_term)), lambda t: t != "")


def _any_of(markers: list[str]) -> str:
    """A pattern for any of the markers: without those that hold another one, tried only where one of their first letters stands."""
    least = [m for m in markers if not any(o != m and o in m for o in markers)]
    return f"(?=[{''.join(sorted({m[0] for m in least}))}])(?:{'|'.join(least)})"


def concepts_of(tag: Column) -> Column:
    """All concepts with a marker inside the tag, in their own order; without any, the tag itself."""
    t = F.lower(tag)
    found = F.array_compact(F.array(*[F.when(F.regexp_like(t, F.lit(_any_of(markers))), F.lit(name)) for name, markers in CONCEPTS.items()]))
    # bound once: the markers aren't searched again for the result
    return F.get(F.transform(F.array(found), lambda f: F.when(F.size(f) > 0, f).otherwise(F.array(t))), F.lit(0))


def concepts_of_all(tags: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(tags, concepts_of)))


def overlap(a: Column, b: Column) -> Column:
    """Number of concepts that two concept sets share."""
    return F.size(F.array_intersect(a, b))


def same_concept(a: Column, b: Column) -> Column:
    """Whether two tags are equal or fall under one concept."""
    return (F.lower(a) == F.lower(b)) | F.arrays_overlap(concepts_of(a), concepts_of(b))


def is_concept_tag(tag: Column) -> Column:
    return F.regexp_like(tag, F.lit("^[a-z][a-z0-9_]+$"))
