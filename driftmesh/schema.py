"""Schemas of the tables a mesh is held in; ids are long throughout."""

POINTS = "pt_id long, x double, y double, z double"
VOLUME = "node_id long, zone_id int, x0 double, y0 double, z0 double"
FACES = "face_id long, patch_id int, nodes array<long>"
PATCHES = "patch_id int, name string, bc_type string, is_wall boolean, is_symm boolean"
ZONES = "zone_id int, name string, structured boolean, il int, jl int, kl int, n_vertices long, n_elements long"
STREAMS = "zone_id int, sec_id int, elem_type int, elem_start long, conn array<long>"
BOCOS = "zone_id int, boco_id int, name string, bc_type string, family string, pt_range array<array<int>>, elements array<long>"
SECTIONS = "zone_id int, sec_id int, name string, elem_type int, elem_start long, elem_end long"
ELEMENTS = "zone_id int, sec_id int, elem_id long, elem_type int, nodes array<long>"
PLANES = "plane_id int, px double, py double, pz double, nx double, ny double, nz double"
SOLVER_MAP = "solver_dof long, common_dof long"
INSTANCES = "inst_id int, name string, block_lo int, block_hi int, dof_lo long, dof_hi long"
TREE = "node_id int, parent_id int, left_id int, right_id int, level int, l int, u int, n int, cx double, cy double, cz double, inv_r double, a double, err array<double>"

#: Boundary conditions that count as walls, the symmetry condition, and face types that form a surface in
#: polyhedral cases.
WALL_TYPES = ("bcwall", "bcwallviscous", "bcwallinviscid", "bcwallviscousheatflux", "bcwallviscousisothermal")
SYMMETRY_TYPE = "bcsymmetryplane"
SURFACE_FACE_TYPES = ("patch", "wall", "slip")

#: Codes of element types with the number of their nodes, the code of sections that mix them, and those
#: that form surfaces.
ELEMENT_NODES = {2: 1, 3: 2, 4: 3, 5: 3, 6: 6, 7: 4, 8: 8, 9: 9, 10: 4, 11: 10, 12: 5, 13: 14, 14: 6, 15: 15, 16: 18, 17: 8, 18: 20, 19: 27}
MIXED = 20
SURFACE_ELEMENTS = (5, 7)

#: The default family of a boundary condition without one, by type.
DEFAULT_FAMILIES = {
    "BCAxisymmetricWedge": "axi",
    "BCDegenerateLine": "degenerate",
    "BCDegeneratePoint": "degenerate",
    "BCDirichlet": "dirichlet",
    "BCExtrapolate": "extrap",
    "BCFarfield": "far",
    "BCGeneral": "general",
    "BCInflow": "inflow",
    "BCInflowSubsonic": "inflow",
    "BCInflowSupersonic": "inflow",
    "BCNeumann": "neumann",
    "BCOutflow": "outflow",
    "BCOutflowSubsonic": "outflow",
    "BCOutflowSupersonic": "outflow",
    "BCSymmetryPlane": "sym",
    "BCSymmetryPolar": "sympolar",
    "BCTunnelInflow": "inflow",
    "BCTunnelOutflow": "outflow",
    "BCWall": "wall",
    "BCWallInviscid": "wall",
    "BCWallViscous": "wall",
    "BCWallViscousHeatFlux": "wall",
    "BCWallViscousIsothermal": "wall",
    "FamilySpecified": "wall",
}
